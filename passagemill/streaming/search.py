"""Search requests arriving as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagemill.operators.embedding import embed_hash
from passagemill.operators.filters import rejected_requests, valid_requests, validate_requests
from passagemill.operators.hits import to_response
from passagemill.plans.ingest import Embedder
from passagemill.plans.search import search
from passagemill.settings import Settings
from passagemill.sources.requests import parse_requests
from passagemill.sources.store import load_store


def search_stream(
    bodies: DataFrame, store: str, output: str, checkpoint: str, settings: Settings = Settings(),
    embedder: Embedder = embed_hash, available_now: bool = True, replies: str | None = None,
) -> StreamingQuery:
    """Answer a stream of (q_id, body) JSON requests into ``output``.

    Every batch is a stateless search over the store as it is at that moment;
    its folder is overwritten when the batch is replayed. With ``replies``,
    that folder has one row for each request, also for those without hits and
    those that were rejected: q_id, status, reason and the JSON response.
    """

    def answer_batch(batch: DataFrame, batch_id: int) -> None:
        rows = load_store(batch.sparkSession, store)
        if rows is None:
            raise FileNotFoundError(f"no store at {store}")
        asked = parse_requests(batch)
        target = f"{output}/batch={batch_id}"
        search(asked, rows, settings, embedder).write.mode("overwrite").parquet(target)
        if replies is not None:
            hits = batch.sparkSession.read.parquet(target)
            checked = validate_requests(asked)
            answers = to_response(valid_requests(checked), hits).select(
                "q_id", F.lit("answered").alias("status"), F.lit(None).cast("string").alias("reason"), "response")
            refused = rejected_requests(checked).select("q_id", "status", "reason", F.lit(None).cast("string").alias("response"))
            answers.unionByName(refused).write.mode("overwrite").parquet(f"{replies}/batch={batch_id}")

    writer = bodies.writeStream.option("checkpointLocation", checkpoint).foreachBatch(answer_batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
