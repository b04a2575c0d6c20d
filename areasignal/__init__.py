"""A PySpark-native engine for area-level multimodal analytics."""
