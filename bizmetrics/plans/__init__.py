"""Metrics over the two cleaned tables, the metric registry and the reports."""
