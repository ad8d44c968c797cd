"""Grounded analytics over tables and a small governed document corpus, on PySpark."""
