"""Tessera: a Spark-native engine for curating large content collections."""
