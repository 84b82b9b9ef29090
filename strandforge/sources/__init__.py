"""Readers and writers of sequence formats."""
