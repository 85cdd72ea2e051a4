"""Idempotent ingest: batches with a digest, versioned documents, and the streaming form of both."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import materialize


def digest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with ``digest``: equal for equal content."""
    return df.withColumn("digest", F.sha2(F.to_json(F.struct(*columns)), 256))


def merge_documents(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The documents after a batch: a replayed document (same key and digest) changes nothing, other bytes are an error."""
    conflict = batch.alias("n").join(base.alias("o"), key).filter("n.digest <> o.digest").limit(1).count()
    inside = batch.groupBy(key).agg(F.countDistinct("digest").alias("d")).filter("d > 1").limit(1).count()
    if conflict or inside:
        raise Conflict("the same id with other content")
    return base.unionByName(batch.dropDuplicates([key]).join(base.select(key), key, "left_anti"))


MOST_DOCUMENTS, MOST_BYTES = 256, 16 << 20


class Conflict(ValueError):
    """The same id with other content."""


@dataclass
class Batch:
    """Documents that are ingested together or not at all, under an id of their own."""

    id: str
    documents: DataFrame
    key: str
    columns: list[str]

    @cached_property
    def measure(self) -> tuple[int, int, str]:
        """Documents, bytes and digest; the digest does not depend on the order of the rows. At most MOST_DOCUMENTS + 1 rows reach the driver."""
        rows = digest(self.documents, self.key, [self.key, *self.columns])
        size = F.octet_length(F.to_json(F.struct(self.key, *self.columns)))
        got = rows.select("digest", size.alias("bytes")).limit(MOST_DOCUMENTS + 1).collect()
        if not 0 < len(got) <= MOST_DOCUMENTS or sum(r["bytes"] for r in got) > MOST_BYTES:
            raise ValueError(f"a batch has 1 to {MOST_DOCUMENTS} documents and at most {MOST_BYTES} bytes")
        return len(got), sum(r["bytes"] for r in got), sha256("".join(sorted(r["digest"] for r in got)).encode()).hexdigest()


class Collection:
    """A collection of documents and the ledger of the batches it has taken."""

    def __init__(self, documents: DataFrame, key: str, ledger: dict[str, tuple[str, int]] | None = None) -> None:
        self.documents, self.key, self.ledger = documents, key, dict(ledger or {})

    def status(self, batch_id: str) -> str:
        return "committed" if batch_id in self.ledger else "unknown"

    def ingest(self, batch: Batch) -> tuple[str, int]:
        """``applied`` or ``replayed``, and the number of documents. A batch known by its id changes nothing; with other content it is an error."""
        n, _, content = batch.measure
        if batch.id in self.ledger:
            known, documents = self.ledger[batch.id]
            if known != content:
                raise Conflict(batch.id)
            return "replayed", documents
        rows = digest(batch.documents, batch.key, batch.columns)
        self.documents = materialize(merge_documents(self.documents, rows, self.key))
        self.ledger[batch.id] = content, n
        return "applied", n

    def replace(self, document: DataFrame) -> None:
        """Full images take the place of the documents of the same key; columns they leave out become null."""
        self.documents = materialize(self.documents.join(document.select(self.key), self.key, "left_anti").unionByName(document, allowMissingColumns=True))

    def delete(self, keys: DataFrame) -> int:
        """The number of documents that were there and are gone."""
        n = self.documents.join(keys.select(self.key).distinct(), self.key, "left_semi").count()
        if n:
            self.documents = materialize(self.documents.join(keys.select(self.key), self.key, "left_anti"))
        return n


class Stream:
    """A bounded queue in front of a collection: a batch is taken whole or refused, and leaves the queue only when it is stored."""

    def __init__(self, collection: Collection, most_bytes: int, most_batches: int, most_ids: int) -> None:
        if min(most_bytes, most_batches, most_ids) < 1:
            raise ValueError("bounds of 1 or more")
        self.collection, self.bounds = collection, (most_bytes, most_batches, most_ids)
        self.queue: deque[Batch] = deque()
        self.known: dict[str, str] = {}

    @property
    def bytes(self) -> int:
        return sum(b.measure[1] for b in self.queue)

    def enqueue(self, batch: Batch) -> str:
        """``enqueued``, or ``idempotent`` for a batch met before."""
        _, size, content = batch.measure
        if batch.id in self.known:
            if self.known[batch.id] != content:
                raise Conflict(batch.id)
            return "idempotent"
        most_bytes, most_batches, most_ids = self.bounds
        if len(self.queue) == most_batches or len(self.known) == most_ids or self.bytes + size > most_bytes:
            raise OverflowError("the stream is full")
        self.queue.append(batch)
        self.known[batch.id] = content
        return "enqueued"

    def flush_next(self) -> tuple[str, int] | None:
        """Stores the oldest batch; if that fails it stays in the queue."""
        if not self.queue:
            return None
        got = self.collection.ingest(self.queue[0])
        self.queue.popleft()
        return got


def replace_documents(base: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Full-image replacement: of the rows of a key the one of the greatest ``order`` stays."""
    both = base.unionByName(batch)
    names = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*names), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}") for c in names])


def stream_events(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, ``files`` per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, time: str, length: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Tumbling counts and sums with a watermark for late rows."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, length), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def run_batches(stream: DataFrame, path: str, checkpoint: str, key: str, change: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Append a stream exactly once: each micro-batch goes to its own directory, so a replayed one overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        change(batch).dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
