"""Training-data operators: tokenising, secret scans, decontamination, quality rules and near-dedup.

Nothing outside this package imports it.  Every operator takes DataFrames and
returns a DataFrame; the shared numpy and Spark helpers are ``_bytes`` and ``_spark``.
"""
