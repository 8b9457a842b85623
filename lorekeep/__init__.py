"""Knowledge-store analytics and training-data preparation on PySpark."""
