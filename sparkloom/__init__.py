"""A PySpark-native engine for conversation-run analytics and the data around it."""
