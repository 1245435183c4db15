"""Branchlight: retrieval-agent analytics expressed as Spark DataFrame plans."""
