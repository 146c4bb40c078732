"""Plan shapes shared by the operators: skew-safe joins and the one-shuffle order financials."""
