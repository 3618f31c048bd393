"""Order-revenue analytics as plain PySpark DataFrame functions."""
