"""quillmark: a retrieval-analytics and corpus-processing engine on Spark DataFrames."""
