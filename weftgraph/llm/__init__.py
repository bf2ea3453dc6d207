"""Training-data operators: decontamination, deduplication, mixing, scoring, extraction and scans.

Nothing outside this subpackage imports it, apart from the guarded import in ``__spark_entry__.py``.
"""
