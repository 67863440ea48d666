"""planloom: spatial-capture analytics and corpus preparation on PySpark."""
