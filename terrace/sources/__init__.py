"""Where catalogues, documents and partitioned tables are read from and written to."""
