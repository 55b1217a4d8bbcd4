"""Set analytics over very large, sparse collections of key-value identifiers on Spark."""
