"""The row-local features and the saved tables applied to a file stream."""
