"""quern: spatial entity resolution and agreement analytics on PySpark."""
