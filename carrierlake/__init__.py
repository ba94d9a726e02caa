"""Case-control cohort analytics as Spark jobs: DataFrames in, DataFrames out."""
