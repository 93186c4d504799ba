"""Readers for irregular delimited files, and writers."""
