"""Cell-by-gene matrices, embeddings and their evaluation as Spark DataFrames."""
