"""Readers and writers of the evidence tables."""
