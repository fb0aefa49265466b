"""Operators of a large-scale training-data pipeline (mixing, scans, near-duplicates, scoring,
packing, search). Nothing outside this subpackage imports it; `queries.py` registers one query
per operator and `corpus_pipeline.py` at the repository top chains five of them."""
