"""opsloom: operations analytics, retrieval and training-data preparation on PySpark."""
