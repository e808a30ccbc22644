"""Feature plans, training and scoring plans, and the registered queries."""
