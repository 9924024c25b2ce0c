"""Operators for preparing training corpora: URL filters, packing, token files,
decontamination, PII, near-duplicates, sharding, token counts and quality."""
