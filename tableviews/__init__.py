"""Question answering over tables, prepared and scored with Spark DataFrames."""
