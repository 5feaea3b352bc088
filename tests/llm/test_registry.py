"""The entry points: one query for each operator, SQL only for queries that exist, stages in their order."""

from __future__ import annotations

import re

from robolake.llm import registry


def test_one_query_an_operator():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in registry.QUERIES] == list(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry_has_them():
    import __spark_entry__ as e
    import corpus_pipeline

    assert set(registry.QUERIES) | {"pipeline"} <= set(e.queries()) and set(registry.SQL) <= set(e.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "pack"]
