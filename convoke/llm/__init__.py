"""Operators for preparing training corpora: deduplication, packing, token counts, media columns and scoring."""
