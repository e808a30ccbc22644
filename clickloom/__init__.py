"""Click-through data work on Spark: features, encodings, folds, metrics, learners, blends."""
