"""PySpark-native record cleaning and place-data analytics."""
