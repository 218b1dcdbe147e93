"""palimpsest: compare two editions of a document on Spark, and prepare text at scale."""
