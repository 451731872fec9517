"""Identity queries and corpus processing on Spark DataFrames."""
