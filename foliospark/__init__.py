"""foliospark: document analytics and corpus preparation as Spark DataFrames."""
