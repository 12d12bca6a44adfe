"""quillmill: a Spark-native engine for content ingestion, inventory and digests."""
