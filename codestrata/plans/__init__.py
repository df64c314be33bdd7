"""Whole evaluations composed from operators."""
