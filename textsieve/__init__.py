"""textsieve: exact text search and text analytics on PySpark."""
