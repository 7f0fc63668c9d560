"""Cataloom: a Spark-native engine that builds and curates large record catalogs."""
