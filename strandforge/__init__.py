"""Sequence mining and corpus preparation as lazy Spark plans."""
