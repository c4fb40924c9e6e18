"""sluice: a PySpark-native data engine for multimodal sample collections."""
