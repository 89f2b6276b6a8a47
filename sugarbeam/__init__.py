"""Spark-native analytics for branched sugar sequences and the tables measured on them."""
