"""tessera: content into self-describing, retrieval-ready units, as Spark DataFrames."""
