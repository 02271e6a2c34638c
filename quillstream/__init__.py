"""quillstream: a Spark-native engine for citation-grounded document retrieval and corpus preparation."""
