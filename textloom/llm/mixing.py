"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

All documents of a source expect the same number of copies, target / source size, so the prefix sum of expected
copies at rank r is r times that number. One random offset per source is added, and a document is emitted once per
integer boundary that its interval crosses. Ranks follow (size, doc_id), which spreads the copies evenly over sizes
and keeps the taken words near the target. Ranks are counted in three levels (source and size, blocks of ids, rows),
so that no window holds more than BLOCK ids and a source with a third of all rows is shared by many tasks.

Defined cases: a null text has size 0; a null source is a source, ordered last; a null doc_id counts as -1 in the
order; repeated rows are separate documents; a source whose texts are all empty has target 0 and takes 0 words; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import body, fresh, marked, marks, rid, small, stable, table, written

WEIGHTS, SHARE, CEILING, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: Ids in a block that one window may hold.
BLOCK = 1024


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, docs, target) of each source. sizes: source, size.

    Filling up to a ceiling: sources in order of ceiling / weight reach it one after another, and what is left is
    shared by weight. With C and W the capacity and weight of the sources before and after a place in that order, the
    level there is (T - C) / W; the first place whose own ratio isn't below its level starts the sources that aren't full.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("docs"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(place) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    everything = Window.partitionBy()
    by = by.withColumn("capacity", F.col("source_size") * float(ceiling)).withColumn("ratio", F.col("capacity") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("full", F.coalesce(F.sum("capacity").over(before), F.lit(0.0))).withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("level", (F.sum("source_size").over(everything) * float(share) - F.col("full")) / F.col("rest"))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("level").alias("at")))).over(everything)["at"]
    return by.select("source", "source_size", "docs", F.least("capacity", F.coalesce(level * F.col("weight"), F.col("capacity"))).alias("target"))


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """One row per row of docs: rid, doc_id, size, source_size, target, copies. docs: a stable table, else it is written
    once and rid are those of the written table."""
    docs = stable(docs)
    slim = written(docs.select(rid(docs).alias("rid"), "doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(body(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size")))
    by = targets(slim, weights, share, ceiling)
    number = F.coalesce("doc_id", F.lit(-1)).cast("long")
    slim = slim.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).withColumn("block", F.floor(number / BLOCK))
    blocks = slim.groupBy("src", "size", "block").agg(F.count("*").alias("n"))
    in_size = Window.partitionBy("src", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("at", F.coalesce(F.sum("n").over(in_size), F.lit(0)))
    in_source = Window.partitionBy("src").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    steps = slim.groupBy("src", "size").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(in_source), F.lit(0))).drop("n")
    starts = blocks.join(steps, ["src", "size"]).select("src", "size", "block", (F.col("at") + F.col("base")).alias("start"))
    ranked = slim.withColumn("r", F.row_number().over(Window.partitionBy("src", "size", "block").orderBy(number, "rid")))
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("src")).cast("binary"), 256), 1, 5), 16, 10).cast("double") / float(1 << 20)
    plan = small(by.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).withColumn("u", offset).withColumn("e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).drop("source", "docs"))
    out = ranked.join(starts, ["src", "size", "block"]).join(plan, "src")
    rank = F.col("start") + F.col("r")
    crossed = F.floor(rank * F.col("e") + F.col("u")) - F.floor((rank - 1) * F.col("e") + F.col("u"))
    return out.select("rid", "doc_id", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mix: every row of docs as many times as it was taken, with docs' columns."""
    docs = stable(docs)
    taken = copies(docs, **parameters).where("copies > 0").select("rid", F.col("copies").alias("value"))
    # No row is taken more often than the ceiling, rounded up.
    most = math.ceil(parameters.get("ceiling", CEILING)) + 1
    out, key, value = marked(docs, marks(taken, most), most)
    (turn,) = fresh(out, "turn_")
    return out.where(F.col(value) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(value).cast("int")))).drop(key, value, turn)


def op5_mix(spark, sf_dir: str) -> DataFrame:
    out = copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS capacity FROM s),
l AS (SELECT *, capacity / weight AS ratio, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * 1.5::DOUBLE
  - coalesce(sum(capacity) OVER (ORDER BY capacity / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY capacity / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT src, source_size, least(capacity, coalesce((SELECT arg_min(level, ratio) FROM l WHERE ratio >= level) * weight, capacity)) AS target,
  CAST(('0x' || substr(sha256('{SEED}:' || src), 1, 5)) AS BIGINT) / 1048576.0::DOUBLE AS u FROM l),
r AS (SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e, row_number() OVER (PARTITION BY d.src ORDER BY size, doc_id) AS n FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target, CAST((floor(n * e + u) - floor((n - 1) * e + u)) * size AS BIGINT) AS taken FROM r
"""
