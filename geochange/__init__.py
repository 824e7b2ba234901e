"""geochange: a PySpark-native engine for change analytics over Earth-observation archives."""
