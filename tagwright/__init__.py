"""Known-target sequence assignment and training-data preparation on Spark."""
