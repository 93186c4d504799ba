"""The composite analyses, from ingest to plot-ready tables."""
