"""quarryspark: retrieval-augmented question answering and training-data jobs on Spark DataFrames."""
