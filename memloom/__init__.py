"""memloom: grounded-memory analytics and training-data operators on PySpark."""
