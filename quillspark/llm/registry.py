"""What the subpackage registers: its queries, the corpus pipeline, and their SQL."""

from __future__ import annotations

from . import queries as q
from . import sql


def queries() -> dict:
    import corpus_pipeline

    return {**q.queries(), "pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return sql.oracles()
