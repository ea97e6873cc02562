"""tesserae: staged document analytics on Spark DataFrames."""
