"""Operators put together: cleaning, profiling, category reports."""
