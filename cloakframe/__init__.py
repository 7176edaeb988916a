"""cloakframe: PySpark-native text de-identification and corpus analytics."""

__version__ = "0.1.0"
