"""kinfold: configuration-driven record analytics and entity resolution on Spark DataFrames."""
