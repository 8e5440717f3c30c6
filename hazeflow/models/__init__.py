"""Training, scoring and explaining regressors with pyspark.ml."""
