"""Readers and the domain relations that they feed."""
