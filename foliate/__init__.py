"""foliate: a Spark-native document-intelligence engine over a flat block table."""
