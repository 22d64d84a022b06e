"""Session analytics on Spark: change feeds in, a star schema and three wide marts out."""
