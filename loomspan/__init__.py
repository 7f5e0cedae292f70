"""loomspan: a PySpark-native analytics engine for catalogues of text records."""
