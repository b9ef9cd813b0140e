"""tidemark: index, news and portfolio analytics expressed as Spark jobs."""
