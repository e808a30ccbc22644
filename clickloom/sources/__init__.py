"""Tables, prediction files, the feature cache and stored artefacts."""
