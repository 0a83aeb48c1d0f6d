"""Corpus tables: the adapter of ``documents``, JSONL scans and sinks, source manifests, fetches and their log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X
from textloom.operators.order import fresh, positions, sums_before
from textloom.sources.tables import clear, slim_batches, written

# Lanes, tiers and splits; what may be evaluation data and how much of it; a manifest's size and tolerance.
LANES, TIERS, SPLITS = ("web", "code", "math", "indic", "multilingual"), ("T0", "T1", "T2", "T3"), ("train", "eval")
EVAL_TIERS, EVAL_FRACTION, EVAL_SEED = ("T0", "T1"), 0.015, "v5-eval-2026"
POOL_TOKENS, POOL_TOLERANCE = 10_000_000, 0.05
DOCUMENT = T.StructType([T.StructField(n, T.StringType(), False) for n in ("id", "lane", "provenance_tier", "split", "source", "text")])
SOURCE = "source_id string, lane string, provenance_tier string, dataset string, text_field string, license string, target_tokens long, gated boolean"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as corpus records. pos, the document's number, is the order of records; an id is its source and its
    number, of seven digits or more, and orders nothing."""
    slim_batches(spark)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.substring("source", 4, 9).cast("int")
    lane = F.when(F.col("lang") == "en", F.element_at(F.array(*map(F.lit, LANES[:3])), n % 3 + 1)).when(F.col("lang") == "es", "indic").otherwise("multilingual")
    return d.select("doc_id", F.col("doc_id").cast("long").alias("pos"), F.format_string("%s-%07d", "source", "doc_id").alias("id"), F.col("source").alias("source_id"), lane.alias("lane"), F.concat(F.lit("T"), (n % 4).cast("string")).alias("provenance_tier"), "text", X.est_tokens(F.col("text")).alias("est_tokens"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(F.col("item_id").cast("long").alias("pos"), F.format_string("bench-%07d", F.col("item_id").cast("long")).alias("id"), "text")


def source_of(id_: Column) -> Column:
    """The source in an id: all before its last hyphen."""
    return F.regexp_replace(id_, "-[^-]*$", "")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str = DOCUMENT, missing_ok: bool = False) -> DataFrame:
    """One object a line, blank lines aside; an absent file is empty if that is allowed."""
    if missing_ok:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    """Canonical lines: keys in order, no spaces; one folder for each value of ``by``."""
    keys = sorted(c for c in df.columns if c != by)
    writer = df.select(*keys, *([by] if by else [])).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).option("ignoreNullFields", "false").json(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a ledger; rows that are there stay as they are."""
    df.write.mode("append").parquet(path)


def capped_prefix(rows: DataFrame, keys: list[str], order: str, tokens: str, cap: Column) -> DataFrame:
    """Rows of each key in order until their tokens reach the cap; the row that crosses it is the last."""
    (before,) = fresh(rows, "before_")
    return sums_before(rows, keys, order, **{before: F.col(tokens)}).where(F.col(before) < cap).drop(before)


def fetch(rows: DataFrame, source_id: str, lane: str, tier: str, revision: str | None, text_field: str, target_tokens: int, order: str) -> DataFrame:
    """Documents of an upstream table: blank texts are skipped but numbered, ids minted, tokens capped. A pin is required.

    text_field: a column of strings, or of structs or maps of which ``field.key`` names a string. pos is the row's number.
    """
    if not revision:
        raise ValueError("a source needs a pinned revision")
    numbered = positions(rows.select(F.col(order).alias("order_"), F.col(text_field).cast("string").alias("text")), "order_")
    text = F.col("text")
    docs = numbered.where(F.length(F.regexp_replace(text, r"(?U)\s+", "")) > 0).select("pos", F.format_string("%s-%07d", F.lit(source_id), "pos").alias("id"), F.lit(lane).alias("lane"), F.lit(tier).alias("provenance_tier"), F.lit("train").alias("split"), F.lit(f"{source_id}@{revision}").alias("source"), "text", X.est_tokens(text).alias("est_tokens"))
    return capped_prefix(docs, [], "pos", "est_tokens", F.lit(target_tokens))


def source_problems(sources: DataFrame, pool: int = POOL_TOKENS, tolerance: float = POOL_TOLERANCE) -> DataFrame:
    """source_id, problem: what is wrong with a manifest (SOURCE), the first problem of each source, then of the whole."""
    blank = lambda c: F.col(c).isNull() | (F.length(F.trim(F.col(c))) == 0)
    outside = lambda c, of: F.col(c).isNull() | ~F.col(c).isin(*of)
    again = F.count("*").over(Window.partitionBy("source_id"))
    rule = F.when(blank("source_id"), "source_id").when(again > 1, "duplicate source_id").when(outside("lane", LANES), "lane").when(outside("provenance_tier", TIERS), "provenance_tier")
    for c in ("dataset", "text_field", "license"):
        rule = rule.when(blank(c), c)
    rule = rule.when(F.coalesce(F.col("target_tokens"), F.lit(0)) <= 0, "target_tokens").when(F.coalesce(F.col("gated"), F.lit(True)), "gated")
    own = sources.select("source_id", rule.alias("problem")).where("problem IS NOT NULL")
    lanes = lane_targets(sources).where("target_tokens = 0").select(F.lit(None).cast("string").alias("source_id"), F.concat(F.lit("no source for "), "lane").alias("problem"))
    total = sources.agg(F.coalesce(F.sum("target_tokens"), F.lit(0)).alias("t")).where(F.abs(F.col("t") - pool) > tolerance * pool)
    return own.unionByName(lanes).unionByName(total.select(F.lit(None).cast("string").alias("source_id"), F.lit("pool size").alias("problem")))


def lane_targets(sources: DataFrame) -> DataFrame:
    """lane, target_tokens of every lane, 0 where no source feeds it."""
    lanes = sources.sparkSession.createDataFrame([(x,) for x in LANES], "lane string")
    got = sources.groupBy("lane").agg(F.sum("target_tokens").alias("t"))
    return lanes.join(F.broadcast(got), "lane", "left").select("lane", F.coalesce("t", F.lit(0)).cast("long").alias("target_tokens"))


LOG = "seq long, source_id string, doc_count long, skipped long, est_tokens long, target_tokens long, revision string"


def fetch_all(sources: DataFrame, upstream: Callable[[str], tuple[DataFrame, str, str]], path: str, force: bool = False, **checks) -> DataFrame:
    """Fetches every source of a sound manifest into path/documents, one folder a source, and returns the log's new rows.

    upstream: of a source_id the table, its pinned revision and the column of its order. A source whose last record in
    path/log has the same revision and target isn't fetched again unless forced. A manifest is bounded: a row a source.
    """
    spark = sources.sparkSession
    if problems := source_problems(sources, **checks).orderBy("source_id").limit(5).collect():
        raise ValueError(f"unsound manifest: {[tuple(r) for r in problems]}")
    log = read_parquet(spark, f"{path}/log", LOG)
    held, start = {r.source_id: r for r in last_records(log).collect()}, (log.agg(F.max("seq")).first()[0] or 0) + 1
    new = []
    for s in sources.orderBy("source_id").collect():
        rows, revision, order = upstream(s.source_id)
        last = held.get(s.source_id)
        if last and not force and (last.revision, last.target_tokens) == (revision, s.target_tokens):
            continue
        docs = written(fetch(rows, s.source_id, s.lane, s.provenance_tier, revision, s.text_field, s.target_tokens, order))
        docs.write.mode("overwrite").parquet(f"{path}/documents/source_id={s.source_id}")
        n, tokens, top = docs.agg(F.count("*"), F.coalesce(F.sum("est_tokens"), F.lit(0)), F.coalesce(F.max("pos"), F.lit(-1))).first()
        new.append((start + len(new), s.source_id, n, top + 1 - n, tokens, s.target_tokens, revision))
    out = spark.createDataFrame(new, LOG)
    append(out, f"{path}/log")
    return out


def read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, empty where nothing is yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def last_records(log: DataFrame, key: str = "source_id", order: str = "seq") -> DataFrame:
    """The latest record of each source in a fetch log."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), order).alias("r")).select("r.*")


def files_sha256(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


__all__ = ["DOCUMENT", "LANES", "SPLITS", "TIERS", "append", "benchmark", "capped_prefix", "clear", "corpus", "fetch", "fetch_all", "files_sha256", "lane_targets", "last_records", "read_jsonl", "read_parquet", "slim_batches", "source_of", "source_problems", "write_jsonl", "written"]
