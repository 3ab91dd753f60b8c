"""Readers for CSV exports and landed board pages, the loader, and the sinks."""
