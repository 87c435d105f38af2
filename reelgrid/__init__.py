"""Timeline alignment and multi-index retrieval as Spark DataFrame operators."""
