"""Plan-level helpers: shared scratch tables, dense numbering, skew-aware joins."""
