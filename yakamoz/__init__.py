"""yakamoz: a Spark-native engine for geo-tagged social text."""
