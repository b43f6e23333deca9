"""Web-document analytics on PySpark."""
