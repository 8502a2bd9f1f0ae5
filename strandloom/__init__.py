"""UMI consensus analytics on Spark, and operators for training-data corpora in strandloom.llm."""
