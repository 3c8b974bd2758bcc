"""Element-wise float32 vector arithmetic and benchmark analytics on Spark DataFrames."""
