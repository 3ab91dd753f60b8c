"""Deals and work-orders analytics on Spark DataFrames."""
