"""tessera: retrieval-style text and vector processing as Spark DataFrame transformations."""
