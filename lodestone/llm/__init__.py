"""Training-data operators: filtering, deduplication, decontamination, scoring, encoding and archiving.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames and keeps what it
needs between passes as Parquet tables in the session's shared checkpoint folder (see ``common``).
"""
