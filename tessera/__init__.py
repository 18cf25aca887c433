"""tessera: knowledge search, graph and training-data analytics on PySpark DataFrames."""
