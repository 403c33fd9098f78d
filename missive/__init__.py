"""missive: a Spark-first engine for mail and document corpora."""
