"""lodegraph: code and document intelligence as Spark DataFrames."""
