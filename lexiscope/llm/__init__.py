"""Operators of a training-data pipeline and their driver queries (``catalog``)."""
