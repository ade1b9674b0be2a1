"""Writers: whole table, fixed-size segments, one part per category."""
