"""corvane: corpus quality, detection evaluation and training-data preparation on Spark."""
