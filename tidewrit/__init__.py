"""PySpark-native spoken-to-written text analytics."""
