"""Incremental jobs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.operators.lifecycle import AUDIT, Claim


def arrive(stream: DataFrame, checkpoint: str, evaluate: Callable[[DataFrame], DataFrame], path: str) -> StreamingQuery:
    """Evaluates documents as they arrive and appends the results; a batch that runs again replaces its own part."""

    def append(batch: DataFrame, batch_id: int) -> None:
        evaluate(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drops uploads that repeat a key within the watermark; a batch table is compared without any bound."""
    if not stream.isStreaming:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def weekly_counts(stream: DataFrame, key: str, time: str, value: str, delay: str = "7 days") -> DataFrame:
    """Documents and sums per key and week from Monday; windows are aligned to a Thursday, hence the start of 4 days."""
    week = F.window(time, "7 days", "7 days", "4 days")
    rows = stream.withWatermark(time, delay) if stream.isStreaming else stream
    return rows.groupBy(key, week.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, F.to_date("w.start").alias("week"), "n", "total")


def last_status(stream: DataFrame, key: str, status: str, order: str) -> DataFrame:
    return stream.groupBy(key).agg(F.max_by(status, order).alias("status"))


def follow_commands(stream: DataFrame) -> DataFrame:
    """The audit rows of a stream of commands (see operators.lifecycle), claims beginning without state. A claim's state, its documents as JSON, is all
    that is kept; a batch's commands are taken in the order of `at`."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        claim = _stored(kept.get[0]) if kept.exists else Claim()
        rows = pd.concat(batches).sort_values("at")
        out = []
        for at, command, document, amount, currency, status, needs in zip(*(rows[c].tolist() for c in ("at", "command", "document_id", "amount", "currency", "status", "needs_confirm")), strict=True):
            outcome, before, after = claim.apply(int(at), command, document, amount, currency, status, needs)
            out.append((key[0], document, at, command, outcome, before, after, claim.total, claim.currency))
        kept.update((json.dumps([claim.status, claim.submitted_at, _plain(claim.total), claim.currency, [[d, s, _plain(a), c, n] for d, (s, a, c, n) in claim.documents.items()]]),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in AUDIT.split(", ")]).astype({"document_id": "Int64"})

    return stream.groupBy("claim_id").applyInPandasWithState(step, AUDIT, "state string", "append", GroupStateTimeout.NoTimeout)


def _plain(amount: Decimal | None) -> str | None:
    return None if amount is None or amount != amount else str(amount)


def _stored(state: str) -> Claim:
    status, submitted_at, total, currency, documents = json.loads(state)
    number = lambda x: None if x is None else Decimal(x)
    return Claim(status, submitted_at, number(total), currency, {d: [s, number(a), c, n] for d, s, a, c, n in documents})
