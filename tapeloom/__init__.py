"""A PySpark-native engine for cataloguing large collections of loosely labelled recordings."""
