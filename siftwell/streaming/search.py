"""A stream of queries against a standing index: top-k per query in each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siftwell.functions import text as T
from siftwell.operators import lexical, rank


def search_stream(queries: DataFrame, postings: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 10, tokenize=T.tokens, once: bool = True) -> StreamingQuery:
    """Scores each micro-batch of a streaming (query_id, query_text) table with the postings and hands its
    top-k (query_id, article_id, score, rank) to ``sink(batch, batch_id)``. The postings are read, not
    rebuilt; keep them written by term. Restarts go on from ``checkpoint``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        terms = lexical.query_terms(batch, tokenize)
        sink(rank.top_k(lexical.score_postings(terms, postings), k), batch_id)

    writer = queries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
