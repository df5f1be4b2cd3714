"""pagelens: page, search-result and training-text analytics as Spark DataFrames."""
