"""Registered queries of this subpackage and their SQL, collected from its modules."""

from __future__ import annotations

from finstrata.llm import (
    bpe_codec, collocations, cutting_stock, decontaminate, histogram_sort, ngram_join, periodic_runs, pii, quality, secrets, separator_scan, token_files, url_filter,
)

MODULES = [token_files, ngram_join, cutting_stock, secrets, quality, pii, url_filter, decontaminate, separator_scan, histogram_sort, collocations, bpe_codec, periodic_runs]
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
