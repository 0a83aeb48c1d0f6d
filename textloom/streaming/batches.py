"""A stream of batches that are functions of a seed and a number: bounded reads, ledgers, replay, resume, fork, and a
streaming source whose offset is the batch number."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from textloom.operators.order import positions
from textloom.operators.packing import tokens_hash
from textloom.sources.corpus import append, read_parquet
from textloom.sources.tables import written

MASTER_SEED, BATCH = "v5-batch-stream-2026", 8


def derive_seed(seed: str, index: Column) -> Column:
    """The first eight bytes of a hash, as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), index.cast("string")).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def lane_probabilities(sequences: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """lane, n, p: by size, or by weights over the lanes that are there, or even if those sum to nothing."""
    lanes = sequences.groupBy("lane").agg(F.count("*").alias("n"))
    raw = F.col("n").cast("double")
    if weights is not None:
        raw = F.lit(0.0)
        for lane, w in weights.items():
            raw = F.when(F.col("lane") == lane, max(0.0, float(w))).otherwise(raw)
    every = Window.partitionBy()
    lanes = lanes.withColumn("_w", raw).withColumn("_w", F.when(F.sum("_w").over(every) > 0, F.col("_w")).otherwise(1.0))
    return lanes.select("lane", "n", (F.col("_w") / F.sum("_w").over(every)).alias("p"))


def draw(seed: str, index: int, lanes: list[tuple[str, int, float]], size: int) -> list[tuple[str, int]]:
    """(lane, place in the lane) of each slot of a batch."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{index}".encode()).digest()[:8], "big"))
    p, out = np.array([x[2] for x in lanes]), []
    for _ in range(size):
        name, n, _ = lanes[int(rng.choice(len(lanes), p=p))]
        out.append((name, int(rng.integers(n))))
    return out


class BatchStream:
    """Batches over a table of sequences: seq (long), lane, tokens, n_loss."""

    def __init__(self, sequences: DataFrame, seed: str = MASTER_SEED, batch_size: int = BATCH, weights: dict[str, float] | None = None):
        self.sequences, self.seed, self.batch_size, self.weights = sequences, seed, batch_size, weights
        self.lanes = [tuple(r) for r in lane_probabilities(sequences, weights).orderBy("lane").collect()]
        # Places are numbered over (lane, seq) alone and written once; tokens meet them only where they are drawn.
        ranked = positions(sequences.select("lane", "seq"), "lane", "seq", name="rank_")
        first = ranked.groupBy("lane").agg(F.min("rank_").alias("first_"))
        self.placed = written(ranked.join(F.broadcast(first), "lane").select("lane", "seq", (F.col("rank_") - F.col("first_")).alias("place")))

    def reseed(self, seed: str) -> BatchStream:
        """The same sequences under another seed."""
        other = copy(self)
        other.seed = seed
        return other

    def slots(self, start: int, stop: int) -> DataFrame:
        """batch_index, slot, lane, place of the batches from start to stop."""
        seed, lanes, size = self.seed, self.lanes, self.batch_size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([(i, k, lane, at) for i in batch["id"] for k, (lane, at) in enumerate(draw(seed, int(i), lanes, size))], columns=["batch_index", "slot", "lane", "place"])

        return self.sequences.sparkSession.range(start, stop).mapInPandas(run, "batch_index long, slot int, lane string, place long")

    def batches(self, start: int, stop: int) -> DataFrame:
        """batch_index, batch_id, content_hash, seq_indices, n_tokens, n_loss of the batches from start to stop."""
        rows = self.slots(start, stop).join(self.placed, ["lane", "place"]).join(self.sequences, ["lane", "seq"])
        each = rows.groupBy("batch_index").agg(F.array_sort(F.collect_list(F.struct("slot", "seq", "tokens", "n_loss"))).alias("r"))

        flat = F.flatten(F.transform("r", lambda x: x.tokens))
        out = each.select("batch_index", tokens_hash(flat).alias("content_hash"), F.transform("r", lambda x: x.seq).alias("seq_indices"), F.size(flat).cast("long").alias("n_tokens"), F.expr("aggregate(r, 0L, (s, x) -> s + x.n_loss)").alias("n_loss"))
        return out.select("batch_index", F.substring("content_hash", 1, 16).alias("batch_id"), "content_hash", "seq_indices", "n_tokens", "n_loss")


    def tokens_of(self, start: int, stop: int) -> DataFrame:
        """batch_index, slot, tokens: the rows of the batches' matrices."""
        rows = self.slots(start, stop).join(self.placed, ["lane", "place"]).join(self.sequences, ["lane", "seq"])
        return rows.select("batch_index", "slot", "tokens")


LEDGER = "batch_index long, batch_id string, content_hash string, seq_indices array<long>, n_tokens long, n_loss long"


def consume(stream: BatchStream, path: str, target: int) -> DataFrame:
    """Appends the batches before target that the ledger at path lacks, and returns them. The ledger's offset never falls:
    a smaller target adds nothing."""
    spark = stream.sequences.sparkSession
    ledger = read_parquet(spark, path, LEDGER)
    new = written(resume(stream, ledger, target))
    append(new, path)
    return new


def offset(ledger: DataFrame) -> int:
    """The next batch: one more than the largest number in the stored ledger, whatever session wrote it."""
    return (ledger.agg(F.max("batch_index")).first()[0] + 1) if ledger.limit(1).count() else 0


def replay(stream: BatchStream, ledger: DataFrame, start: int, stop: int) -> DataFrame:
    """batch_index, matched for start to stop; a batch that the ledger lacks doesn't match."""
    rebuilt = stream.batches(start, stop).select("batch_index", F.col("content_hash").alias("a"), F.col("seq_indices").alias("x"))
    said = ledger.select("batch_index", F.col("content_hash").alias("b"), F.col("seq_indices").alias("y"))
    return rebuilt.join(said, "batch_index", "left").select("batch_index", (F.col("a").eqNullSafe(F.col("b")) & F.col("x").eqNullSafe(F.col("y"))).alias("matched"))


def resume(stream: BatchStream, ledger: DataFrame, target: int) -> DataFrame:
    """What is still to be consumed of the batches before target; never a batch again."""
    return stream.batches(done := offset(ledger), max(done, target))


def fork(stream: BatchStream, at: int, seed: str, steps: int, branch: str) -> DataFrame:
    """One row of lineage: the branch's batches from the offset on, and whether its first differs from the parent's."""
    own = stream.reseed(seed).batches(at, at + steps)
    first = lambda df, c: df.where(F.col("batch_index") == at).select(F.col("content_hash").alias(c))
    ids = own.agg(F.transform(F.array_sort(F.collect_list(F.struct("batch_index", "batch_id"))), lambda x: x.batch_id).alias("branch_batch_ids"))
    both = first(own, "a").crossJoin(first(stream.batches(at, at + 1), "b"))
    return ids.crossJoin(both).select(F.lit(branch).alias("branch_id"), F.lit(seed).alias("seed"), F.lit(at).cast("long").alias("diverged_at"), (F.col("a") != F.col("b")).alias("diverged"), F.lit(steps).cast("long").alias("steps"), F.lit(stream.seed).alias("parent_seed"), "branch_batch_ids")


class SlotSource(DataSource):
    """Streaming source ``batch_slots``: options seed, size, lanes ("name:n:p,..."), start, rate (batches a trigger), end.
    Its offset is the batch number, so a restart from a checkpoint neither skips nor repeats."""

    @classmethod
    def name(cls) -> str:
        return "batch_slots"

    def schema(self) -> str:
        return "batch_index long, slot int, lane string, place long"

    def simpleStreamReader(self, schema) -> SlotReader:
        return SlotReader(self.options)


class SlotReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.seed, self.size = options.get("seed", MASTER_SEED), int(options.get("size", BATCH))
        self.lanes = [(a, int(n), float(p)) for a, n, p in (x.split(":") for x in options["lanes"].split(","))]
        self.start, self.rate, self.end = int(options.get("start", 0)), int(options.get("rate", 16)), int(options.get("end", 1 << 62))

    def initialOffset(self) -> dict:
        return {"batch": self.start}

    def _rows(self, start: int, stop: int):
        return iter([(i, k, lane, at) for i in range(start, stop) for k, (lane, at) in enumerate(draw(self.seed, i, self.lanes, self.size))])

    def read(self, start: dict):
        stop = min(start["batch"] + self.rate, self.end)
        return self._rows(start["batch"], stop), {"batch": max(stop, start["batch"])}

    def readBetweenOffsets(self, start: dict, end: dict):
        return self._rows(start["batch"], end["batch"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SlotSource)


__all__ = ["LEDGER", "BatchStream", "SlotSource", "consume", "derive_seed", "draw", "fork", "lane_probabilities", "offset", "register", "replay", "resume"]
