"""Spatial enrichment and causal auditing of tabular feeds, as lazy Spark plans."""
