"""Writers. Each runs one Spark job and returns nothing or a path."""
