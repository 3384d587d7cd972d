"""passagework: passage search, linking and corpus processing on Spark DataFrames."""
