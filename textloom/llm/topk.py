"""Exact top-k search by inner product over a bit-sliced index.

Every component becomes floor(64 x). A block of rows, sorted by id, is kept as bitmaps: bit b of component d of all
rows is one slice. The score of a query against all rows of a block is a sum of shifted slices, one group for each
signed binary digit of each query component; slices of equal weight are added by carry-save adders over whole bitmaps.
From the most significant slice of the sums downward the rows that surely belong to the top k are told apart from those
that surely don't; rows that are still equal at the last slice are taken in the order of their ids, and the scores of
the rows taken are computed exactly from their components.

Queries, in blocks, meet every block of the index; each pair of blocks gives at most k rows a query, of which the best
k stay. No task holds more than a block of either.

Defined cases: vectors null or with null or non-finite components take no part, nor do null ids; a shorter vector
counts as filled up with zeros; vectors whose scores could need more than 64 bits are an error; rows that repeat are separate candidates, and separate queries; a row isn't a candidate
for queries of its own id; equal scores go by the smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import table

SCALE, EVERY, K = 64, 20, 20
#: Rows in a block of the index, queries in a block of queries.
BLOCK, QUERIES = 8192, 512
#: Components from here on are an error.
LARGEST = float(1 << 40)


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(power, sign) of the shortest sum of signed powers of two."""
    out, power = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((power, digit))
            value -= digit
        value >>= 1
        power += 1
    return out


class BitSlicedIndex:
    """Slices of the components of some rows, each over all rows, and their complements."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        n, dims = self.rows.shape
        self.low = self.rows.min(0) if n else np.zeros(dims, np.int64)
        lifted = self.rows - self.low
        self.bits = [int(x).bit_length() for x in (lifted.max(0) if n else self.low)]
        self.words = -(-n // 64)
        planes = [(lifted[:, d] >> b & 1).astype(np.uint8) for d in range(dims) for b in range(self.bits[d])]
        self.at = np.cumsum([0, *self.bits])
        self.planes = self.packed(np.array(planes).reshape(-1, n))
        self.planes = np.concatenate([self.planes, ~self.planes])
        self.valid = self.packed(np.ones((1, n), np.uint8))[0]

    def packed(self, bits: np.ndarray) -> np.ndarray:
        filled = np.zeros((len(bits), self.words * 64), np.uint8)
        filled[:, : bits.shape[1]] = bits
        return np.packbits(filled, axis=1, bitorder="little").view("<u8").reshape(len(bits), self.words)

    def sums(self, query: np.ndarray) -> np.ndarray:
        """Slices, least significant first, of the score of every row, less a constant."""
        by_weight: dict[int, list[int]] = {}
        for d in np.flatnonzero(query[: len(self.bits)]).tolist():
            for power, sign in signed_digits(int(query[d])):
                base = int(self.at[d]) + (0 if sign > 0 else int(self.at[-1]))
                for b in range(self.bits[d]):
                    by_weight.setdefault(power + b, []).append(base + b)
        out, carries, weight = [], [], 0
        while weight <= max(by_weight, default=-1) or carries:
            stack = [self.planes[by_weight[weight]]] if weight in by_weight else []
            stack = np.concatenate(stack + carries) if stack or carries else self.planes[:0]
            carries = []
            while len(stack) > 2:
                k = len(stack) // 3
                a, b, c = stack[:k], stack[k : 2 * k], stack[2 * k : 3 * k]
                either = a ^ b
                carries.append((a & b) | (either & c))
                stack = np.concatenate([either ^ c, stack[3 * k :]])
            if len(stack) == 2:
                carries.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            weight += 1
        return np.array(out).reshape(-1, self.words)

    def places(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, ties to the smaller id; rows of the id ``own`` aside."""
        open_ = self.valid.copy()
        for at in range(np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")):
            open_[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        sure, n_sure = np.zeros_like(open_), 0
        for plane in self.sums(query)[::-1]:
            higher = open_ & plane
            n = n_sure + int(np.bitwise_count(higher).sum())
            if n <= k:
                sure, n_sure, open_ = sure | higher, n, open_ & ~plane
                if n == k:
                    break
            else:
                open_ = higher
        taken = np.concatenate([self.places(sure), self.places(open_)[: k - n_sure]])
        width = min(len(query), self.rows.shape[1])
        return self.ids[taken], self.rows[taken][:, :width] @ query[:width]


def _valid(vectors: DataFrame, id_col: str, col: str) -> DataFrame:
    ok = F.col(id_col).isNotNull() & F.col(col).isNotNull() & F.forall(col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    scaled = lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long")
    held = F.transform(col, lambda x: F.when(F.abs(x.cast("double")) < LARGEST, scaled(x)).otherwise(F.raise_error(F.lit("a component is too large for whole scores")).cast("long")))
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), held.alias("x"))


def _matrix(rows: pd.Series) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


def top_k(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    rows = _valid(vectors, id_col, col)
    blocks = max(1, math.ceil(rows.count() / BLOCK))
    queries = rows.where(F.col("id") % every == 0)
    query_blocks = max(1, math.ceil(queries.count() / QUERIES))

    def pack(size: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, serial = TaskContext.get().partitionId(), 0
            for batch in batches:
                for at in range(0, len(batch), size):
                    own = batch.iloc[at : at + size]
                    x = _matrix(own["x"])
                    yield pd.DataFrame([(part, (part << 32) | serial, own["id"].to_numpy("<i8").tobytes(), x.astype("<i8").tobytes(), x.shape[1])], columns=["part", "serial", "ids", "x", "dims"])
                    serial += size

        return run

    schema = "part int, serial long, ids binary, x binary, dims int"
    index = rows.repartition(blocks).mapInPandas(pack(BLOCK), schema).withColumn("part", F.pmod("part", F.lit(blocks)))
    asked = queries.repartition(query_blocks).mapInPandas(pack(QUERIES), schema)
    asked = asked.select("serial", "ids", "x", "dims").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = index.select("part", F.col("ids").alias("own_ids"), F.col("x").alias("own_x"), F.col("dims").alias("own_dims")).join(asked, "part")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, built = None, None
        for batch in batches:
            for row in batch.itertuples():
                if last != row.own_ids or built is None:
                    ids = np.frombuffer(row.own_ids, "<i8")
                    last, built = row.own_ids, BitSlicedIndex(ids, np.frombuffer(row.own_x, "<i8").reshape(len(ids), row.own_dims))
                ids = np.frombuffer(row.ids, "<i8")
                asked, out = np.frombuffer(row.x, "<i8").reshape(len(ids), row.dims), []
                if max(map(abs, (built.rows.max(initial=0).item(), built.rows.min(initial=0).item()))) * max(map(abs, (asked.max(initial=0).item(), asked.min(initial=0).item()))) * max(1, row.dims) >= 1 << 62:
                    raise ValueError("scores of these vectors may need more than 64 bits")
                for at, (own, query) in enumerate(zip(ids.tolist(), asked, strict=True)):
                    found, scores = built.top(query, own, k)
                    out.append(pd.DataFrame({"asked": row.serial + at, "query_id": own, "vec_id": found, "score": scores}))
                yield pd.concat(out)

    best = pairs.mapInPandas(search, "asked long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
