"""A PySpark-native SELECT engine over CSV and Parquet tables."""
