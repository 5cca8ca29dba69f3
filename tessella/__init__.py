"""Planar partitions (overlap and gap resolution) as PySpark DataFrame transformations."""
