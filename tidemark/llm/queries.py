"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm.divergence_audit import op11_divergence_audit
from tidemark.llm.divergence_audit import oracle_sql as op11_sql
from tidemark.llm.embedding_dedup import op3_embedding_dedup
from tidemark.llm.html_extract import op10_html_extract
from tidemark.llm.importance_resampling import op13_importance_resampling
from tidemark.llm.importance_resampling import oracle_sql as op13_sql
from tidemark.llm.license_scan import op1_license_scan
from tidemark.llm.minhash import minhash_near_duplicates, op12_minhash_fingerprints
from tidemark.llm.packing import op6_packing
from tidemark.llm.quality_rules import op2_quality_rules
from tidemark.llm.simhash_dedup import op8_simhash_dedup
from tidemark.llm.source_mixing import op9_source_mixing
from tidemark.llm.token_files import op7_token_files
from tidemark.llm.toxicity import op4_toxicity
from tidemark.llm.url_filter import op5_url_filter
from tidemark.llm.url_filter import oracle_sql as op5_sql

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_embedding_dedup, op4_toxicity, op5_url_filter, op6_packing, op7_token_files, op8_simhash_dedup, op9_source_mixing, op10_html_extract, op11_divergence_audit, op12_minhash_fingerprints, op13_importance_resampling, minhash_near_duplicates)}

ORACLES: dict[str, str] = {"op5_url_filter": op5_sql(), "op11_divergence_audit": op11_sql(), "op13_importance_resampling": op13_sql()}
