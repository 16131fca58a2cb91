"""Stores of keys and bytes, and the Spark data source over them."""
