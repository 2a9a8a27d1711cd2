"""Table operators: numbering, skew-safe joins and groups, intervals, versions, checks."""
