"""quillspan: retrieval, ranking and graph analytics over text corpora on Spark."""
