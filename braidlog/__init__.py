"""braidlog: retrieval and data processing over conversation logs, on Spark."""
