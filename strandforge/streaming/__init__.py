"""Incremental forms of the occurrence index (an extension: the batch operators define the results)."""
