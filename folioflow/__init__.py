"""Positioned-document analytics on Spark: catalog, pages, sentences, enrichment and ink as DataFrames."""

__version__ = "0.1.0"
