"""Prepare large tables on Spark and audit what the preparation does to them."""
