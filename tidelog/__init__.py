"""Version-log analytics on PySpark."""
