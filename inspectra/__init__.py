"""A PySpark-native content-inspection and incident-analytics engine."""
