"""Open earth-data analytics on Spark: bronze files, silver tables, gold models."""
