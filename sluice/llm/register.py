"""The queries ``opN_<name>`` and their DuckDB SQL, by key."""

from __future__ import annotations

from sluice.llm import (
    bpe, decontaminate, exact_dedup, fill_in_middle, katz_lm, language_id, license_scan, line_dedup, order_minhash, quality_cnn,
    source_divergence, substring_dedup, url_filter)

MODULES = (bpe, decontaminate, exact_dedup, fill_in_middle, katz_lm, language_id, license_scan, line_dedup, order_minhash, quality_cnn,
           source_divergence, substring_dedup, url_filter)

QUERIES = {m.KEY: m.query for m in MODULES}
ORACLES = {m.KEY: m.ORACLE for m in MODULES if m.ORACLE}
