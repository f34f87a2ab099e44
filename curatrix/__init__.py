"""Dataset curation and pose analytics on Spark: lazy DataFrame -> DataFrame operators."""
