"""marlstone: a document-to-knowledge analytics engine on PySpark."""
