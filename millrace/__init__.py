"""Retrieval, graph and text analytics over semi-structured documents, as PySpark DataFrame plans."""
