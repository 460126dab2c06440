"""A corpus retrieval and document-structure engine on Apache Spark."""
