"""newsloom: news and market analytics as declarative PySpark plans."""
