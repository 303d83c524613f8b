"""Evidence jobs on Spark: conversations, code history and retrieval as DataFrame transformations."""
