"""Corpus-scale scanning of source code and text, as Spark DataFrame and SQL plans."""

__version__ = "0.2.0"
