"""folio: a Spark-first engine for document catalogs."""
