"""Evidence-based entity resolution and data fusion on Spark DataFrames."""
