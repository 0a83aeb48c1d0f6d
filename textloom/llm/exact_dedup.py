"""Exact deduplication with counting quotient filters.

Every partition folds the 64-bit fingerprints of its normalised texts into counting quotient filters: a fingerprint's
upper QUOTIENT bits name a run, its remainder lies sorted in the run, and a counter goes with it. Filters are cut by
quotient range, travel as run lengths, remainders and counters, and are merged losslessly by their sorted remainders, so
a fingerprint's count over the whole corpus is exact. Fingerprints counted more than once route their texts to byte
verification; all others are done. Which rows are routed or dropped is told by bitmaps, so no other text is shuffled.

Defined cases: a null text is the empty text; a null doc_id is larger than any other; rows that repeat wholly are
copies of each other and one of them stays; an empty table gives an empty result; other columns, whatever their names,
are carried along.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import body, kept, marked, marks, rid, small, stable, table, written

#: Bits of a fingerprint that name its run, and that are kept of it in the run.
QUOTIENT, REMAINDER = 16, 48
#: Fingerprints that one merged filter holds, about.
FILTER_ROWS = 250_000


class CountingQuotientFilter:
    """Multiset of 64-bit fingerprints. Run q holds the sorted remainders of the fingerprints whose quotient is q."""

    def __init__(self, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.runs, self.remainders, self.counts = runs, remainders, counts

    @classmethod
    def of(cls, prints: np.ndarray) -> CountingQuotientFilter:
        held, counts = np.unique(prints.astype(np.uint64), return_counts=True)
        return cls.cut_into_runs(held, counts)

    @classmethod
    def cut_into_runs(cls, held: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """held: ascending distinct fingerprints."""
        runs = np.bincount((held >> np.uint64(REMAINDER)).astype(np.int64), minlength=1 << QUOTIENT)
        return cls(runs, held & np.uint64((1 << REMAINDER) - 1), counts)

    def prints(self) -> np.ndarray:
        """The fingerprints, ascending: each run's number before each of its remainders."""
        return (np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs) << np.uint64(REMAINDER)) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both multisets in one. Remainders of either lie sorted in their runs, so each of the other's has its place among
        one's own found by bisection; equal ones add their counters, the rest move apart to make room."""
        mine, theirs = self.prints(), other.prints()
        at = np.searchsorted(mine, theirs)
        known = np.zeros(len(theirs), bool)
        known[at < len(mine)] = mine[at[at < len(mine)]] == theirs[at < len(mine)]
        counts = self.counts.copy()
        counts[at[known]] += other.counts[known]
        return self.cut_into_runs(np.insert(mine, at[~known], theirs[~known]), np.insert(counts, at[~known], other.counts[~known]))

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """All in one, two at a time, so that each remainder moves few times."""
        while len(filters) > 1:
            filters = [a.merge(b) for a, b in zip(filters[::2], filters[1::2], strict=False)] + (filters[-1:] if len(filters) % 2 else [])
        return filters[0]

    def cut(self, range_bits: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(quotient range, run lengths, remainders, counters) of each range that holds something."""
        ends = np.cumsum(self.runs)
        width = 1 << (QUOTIENT - range_bits)
        for k in range(1 << range_bits):
            a, b = int(ends[k * width - 1]) if k else 0, int(ends[(k + 1) * width - 1])
            if b > a:
                low = self.remainders[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : REMAINDER // 8].tobytes()
                yield k, zlib.compress(_slim(self.runs[k * width : (k + 1) * width]), 1), low, _slim(self.counts[a:b])

    @classmethod
    def read(cls, part: int, range_bits: int, runs: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        width = 1 << (QUOTIENT - range_bits)
        every = np.zeros(1 << QUOTIENT, np.int64)
        every[part * width : (part + 1) * width] = _wide(zlib.decompress(runs), width)
        n = len(remainders) // (REMAINDER // 8)
        low = np.zeros((n, 8), np.uint8)
        low[:, : REMAINDER // 8] = np.frombuffer(remainders, np.uint8).reshape(n, -1)
        return cls(every, low.reshape(-1).view("<u8").copy(), _wide(counts, n))


def _slim(values: np.ndarray) -> bytes:
    top = int(values.max()) if len(values) else 0
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64)


def repeated_prints(prints: DataFrame, col: str = "fp") -> DataFrame:
    """The values of the long column that more than one row has, with their exact counts: (fp long, n long)."""
    bits = min(QUOTIENT, max(3, math.ceil(math.log2(max(1, prints.count()) / FILTER_ROWS + 1))))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[CountingQuotientFilter] = []
        waiting, rows = [], 0
        columns = ["part", "runs", "remainders", "counts"]
        for batch in batches:
            waiting.append(batch["fp"].to_numpy(np.int64).view(np.uint64))
            rows += len(batch)
            if rows > FILTER_ROWS:
                held = [CountingQuotientFilter.merged([*held, CountingQuotientFilter.of(np.concatenate(waiting))])]
                waiting, rows = [], 0
                if len(held[0].remainders) > 4 * FILTER_ROWS:
                    yield pd.DataFrame(held.pop().cut(bits), columns=columns)
        if waiting:
            held = [CountingQuotientFilter.merged([*held, CountingQuotientFilter.of(np.concatenate(waiting))])]
        for last in held:
            yield pd.DataFrame(last.cut(bits), columns=columns)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        whole = CountingQuotientFilter.merged([CountingQuotientFilter.read(part, bits, *x) for x in zip(group["runs"], group["remainders"], group["counts"], strict=True)])
        again = whole.counts > 1
        return pd.DataFrame({"fp": whole.prints()[again].view(np.int64), "n": whole.counts[again]})

    parts = prints.select(F.col(col).alias("fp")).mapInPandas(fold, "part long, runs binary, remainders binary, counts binary")
    return parts.groupBy("part").applyInPandas(merge, "fp long, n long")


def _normal():
    return F.regexp_replace(body(), r"[ \t-\r]+", "")


def decisions(docs: DataFrame) -> DataFrame:
    """One row per row of docs: rid, doc_id, keep_id, group_size, kept, text_sha256. docs: a stable table, else it is
    written once and rid are those of the written table."""
    docs = stable(docs)
    normal = docs.select(rid(docs).alias("rid"), "doc_id", F.length(body()).alias("cp"), _normal().alias("t"))
    slim = written(normal.select("rid", "doc_id", "cp", F.xxhash64("t").alias("fp"), F.sha2(F.col("t").cast("binary"), 256).alias("sha")))
    again = written(repeated_prints(slim).select("fp"))
    members = written(slim.join(again, "fp", "left_semi"))
    # Byte verification: the routed texts meet as whole byte strings; equal ones have combined before the shuffle.
    routed, _, told = marked(docs, marks(members))
    texts = routed.where(F.col(told) == 1).select(_normal().alias("t")).groupBy("t").count()
    classes = texts.select(F.sha2(F.col("t").cast("binary"), 256).alias("sha"), "count").groupBy("sha").agg(F.count("*").alias("texts"), F.sum("count").alias("group_size"))
    same = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")).cast("long"))
    classes = written(classes.where("group_size > 1").select("sha", same.alias("group_size")))
    # Most code points, then the smallest id (null last), then the first row: a minimum, combined before the shuffle.
    best = F.min(F.struct((-F.col("cp")).alias("cp"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")
    first = members.groupBy("sha").agg(best).select("sha", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))
    groups = written(classes.join(first, "sha"))
    # A hot group's rows have met nothing but minima and counts so far; here Spark can split them.
    out = slim.select("rid", "doc_id", "sha").join(small(groups), "sha", "left")
    alone = F.col("keep_rid").isNull()
    return out.select(
        "rid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    docs = stable(docs)
    return kept(docs, decisions(docs).where(~F.col("kept")).select("rid"))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents")).drop("rid")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY sha ORDER BY cp DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY sha) AS n FROM d)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM k
"""
