"""A Spark-native engine for document analytics and ledger reporting."""
