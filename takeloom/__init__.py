"""takeloom: DataFrame -> DataFrame operators for annotated-corpus analytics on Spark."""
