"""PySpark-native analytics for nested social archives, planar geodata and training corpora."""
