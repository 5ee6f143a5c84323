"""Evidence-grounded claim verification on Spark DataFrames."""
