"""Whole-claim plans composed of the operators."""
