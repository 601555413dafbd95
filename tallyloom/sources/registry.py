"""All connectors by provider, and how well a store can be read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from . import connectors, stores, transcripts
from .assemble import Bundle

#: (spark, folder, machine) -> (graph, one row of the counters malformed and duplicates).
CONNECTORS: dict[str, Callable[..., tuple[Bundle, DataFrame]]] = connectors.CONNECTORS | {f.__name__: f for f in (stores.amp, transcripts.claude, transcripts.codex, transcripts.copilot, transcripts.gemini, stores.goose, transcripts.pi, transcripts.qwen)}


def compatibility(spark: SparkSession, provider: str, home: str) -> str:
    """no-data (there is no store), degraded (it can't be read, or some records can't), compatible (it has conversations) or detected (it has none yet)."""
    try:
        graph, counters = CONNECTORS[provider](spark, home)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return "no-data"
        raise
    try:
        malformed = counters.first().malformed
    except Exception:  # what a store holds is not to be trusted; a verdict must come of any
        return "degraded"
    return "degraded" if malformed else "detected" if graph.conversations.isEmpty() else "compatible"
