"""A PySpark-native engine for declarative document verification."""
