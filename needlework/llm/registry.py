"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from needlework.llm import attention_lm, cgk_decontam, host_suffixes, kk_packing, order_minhash, quality_ledger, ring_shards, suffix_dedup, url_rules, warc_writer

MODULES = [attention_lm, warc_writer, url_rules, kk_packing, host_suffixes, cgk_decontam, order_minhash, suffix_dedup, quality_ledger, ring_shards]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {k: v for m in MODULES for k, v in m.SQL.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
