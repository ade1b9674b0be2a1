"""Readers, the lookup list and the dirty sample."""
