"""gristmill: Spark-native analytics over diffs, documents and review findings."""
