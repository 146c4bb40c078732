"""The registered queries: domain tables derived from the given Parquet tables, and their SQL counterparts."""
