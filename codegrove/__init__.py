"""codegrove: analytics over corpora of Python source code, on Spark DataFrames."""
