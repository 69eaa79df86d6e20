"""PySpark-native select-project-join analytics."""
