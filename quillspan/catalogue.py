"""Every query of the library, by name, with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.plans import answers, audits, cleaning, curation, evaluation, extracted, knowledge, records, retrieval, segments, staged, timeline

_PLANS = [retrieval, answers, evaluation, timeline, knowledge, staged, audits, cleaning, records, curation, extracted, segments]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for p in _PLANS for k, v in p.ORACLES.items()}
FLAGSHIP = "bm25_topk"
