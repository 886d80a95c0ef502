"""Corpus orientation and evidence engine on PySpark."""
