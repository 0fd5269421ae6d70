"""A PySpark-native analytics engine for facts about code and its failures."""
