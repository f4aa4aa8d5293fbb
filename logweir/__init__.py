"""A PySpark-native engine for ordered event logs with durable consumer cursors."""
