"""sparkvane: a Spark-native analytics engine for monitored-source intelligence."""
