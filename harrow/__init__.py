"""A relational engine and a set of corpus operators on PySpark."""
