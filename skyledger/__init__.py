"""A PySpark engine for catalogs of observation records and for training-data preparation."""
