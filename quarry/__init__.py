"""quarry: source-code and document corpus analytics expressed as Spark DataFrames."""
