"""hedgerow: Spark DataFrame operators for planning corpora, policies in force and travel routes."""
