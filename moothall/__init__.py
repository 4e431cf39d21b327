"""Public-meeting analytics and training-data preparation on PySpark."""
