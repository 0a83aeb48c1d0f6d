"""Next-fit bins, token shards with their index and checks, packed sequences with masks."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.order import block, positions
from textloom.sources.tables import slim_batches

SHARD_TOKENS, SEQ_LEN, PAD = 65_536, 256, 0


def next_fit(lengths: np.ndarray, cap: int, bin_: int = 0, used: int = 0) -> np.ndarray:
    """The bin of each item in order: a new one starts where the item doesn't fit the one before. A longer item is alone.
    bin_, used: the bin that is open at the start, and what it holds."""
    out = np.zeros(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        if used and used + n > cap:
            bin_, used = bin_ + 1, 0
        out[k], used = bin_, used + n
    return out


def block_exits(lengths: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What a block of items does to the open bin: (low, new, used, total).

    If the open bin holds u > 0, the first item that opens a new bin is the first j with u > low[j]; the block then opens
    new[j] bins and leaves used[j] in the last. Without such an item it leaves u + total. Whichever item opens a bin,
    the rest follows, so exits are made from the last item backward.
    """
    ends = np.concatenate([[0], np.cumsum(lengths)])
    n = len(lengths)
    # The first item that doesn't fit a bin opened at k; an item longer than a bin is alone, a bin of nothing takes any.
    first = np.searchsorted(ends, ends[:-1], "right")  # the first end behind a positive length
    nxt = np.minimum(np.maximum(np.searchsorted(ends, ends[:-1] + cap, "right") - 1, first), n)
    new, used = np.ones(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for k in range(n - 1, -1, -1):
        j = int(nxt[k])
        new[k], used[k] = (1, ends[n] - ends[k]) if j >= n else (1 + new[j], used[j])
    low = cap - ends[1:]
    some = int(np.searchsorted(-low, 0, "right"))  # once low is negative, any u opens a bin
    return low[: some + 1], new[: min(some + 1, n)], used[: min(some + 1, n)], int(ends[n])


def chain_blocks(blocks: pd.DataFrame, cap: int) -> list[tuple[int, int]]:
    """(number of the open bin, what it holds) where each block of block_exits, in order, begins."""
    out, bin_, used = [], 0, 0
    for low, new, left, total in zip(blocks["low"], blocks["new"], blocks["used"], blocks["total"], strict=True):
        out.append((bin_, used))
        if not used:
            at = 0 if len(new) else None
            bin_ -= at is not None  # a bin of nothing is the one that the block opens
        else:
            over = np.flatnonzero(used > np.asarray(low))
            at = int(over[0]) if len(over) else None
        if at is None:
            used += total
        else:
            bin_, used = bin_ + int(new[at]), int(left[at])
    return out


def bins(items: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """keys, pos, n, bin: next-fit by keys in the order of pos. items: keys, pos (whole numbers, distinct in a key), n.

    Only numbers travel. Blocks of the order are summed up as functions of the bin that is open at their start; those few
    numbers are chained by key, and then each block is filled by itself, so a key's items are shared by many tasks.
    """
    types, at = dict(items.dtypes), [*keys, "block_"]
    fields = ", ".join([*(f"{k} {types[k]}" for k in keys), "block_ long"])
    work = items.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n"))
    work = work.withColumn("block_", block(work))

    def sum_up(group: pd.DataFrame) -> pd.DataFrame:
        low, new, used, total = block_exits(group.sort_values("pos", kind="stable")["n"].to_numpy(), cap)
        return group.iloc[:1][at].assign(low=[low], new=[new], used=[used], total=total)

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block_", kind="stable")
        starts = chain_blocks(group, cap)
        return group[at].assign(bin=[x for x, _ in starts], held=[x for _, x in starts])

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", kind="stable")
        return group.assign(bin=next_fit(group["n"].to_numpy(), cap, int(group["bin"].iloc[0]), int(group["held"].iloc[0])))

    sums = work.groupBy(*at).applyInPandas(sum_up, f"{fields}, low array<long>, new array<long>, used array<long>, total long")
    starts = sums.groupBy(*keys).applyInPandas(chain, f"{fields}, bin long, held long")
    same = F.lit(True)
    for k in at:
        same = same & F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}"))
    placed = work.alias("w").join(starts.alias("s"), same).select("w.*", "s.bin", "s.held")
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "pos long", "n long", "bin long"])
    return placed.groupBy(*at).applyInPandas(lambda g: fill(g)[[*keys, "pos", "n", "bin"]], schema)


def shards(docs: DataFrame, bos: int, eos: int, cap: int = SHARD_TOKENS) -> DataFrame:
    """shard_id, split, lane, bin (its number in the lane), tokens, docs (id, pos, tier, start, length), n_tokens, n_docs,
    hash of token shards.

    docs: id, pos, split, lane, provenance_tier, tokens. Whole documents, framed by bos and eos, go into shards by next fit; the
    hash is over little-endian 16-bit tokens.
    """
    slim_batches(docs.sparkSession)
    framed = docs.select("id", "pos", "split", "lane", "provenance_tier", F.concat(F.array(F.lit(bos)), "tokens", F.array(F.lit(eos))).alias("tokens"))
    placed = framed.join(bins(framed.select("split", "lane", "pos", F.size("tokens").alias("n")), ["split", "lane"], cap).select("pos", "bin"), "pos")
    rows = F.array_sort(F.collect_list(F.struct("pos", "id", "provenance_tier", "tokens")))
    out = placed.groupBy("split", "lane", "bin").agg(rows.alias("rows"))
    start = F.expr("transform(rows, (r, i) -> named_struct('id', r.id, 'pos', r.pos, 'provenance_tier', r.provenance_tier, 'start', aggregate(slice(rows, 1, i), 0, (s, x) -> s + size(x.tokens)), 'length', size(r.tokens)))")
    out = out.select(F.format_string("%s-%s-%04d", "split", "lane", "bin").alias("shard_id"), "split", "lane", "bin", F.flatten(F.transform("rows", lambda r: r.tokens)).alias("tokens"), start.alias("docs"))
    return out.withColumn("n_tokens", F.size("tokens").cast("long")).withColumn("n_docs", F.size("docs").cast("long")).withColumn("hash", tokens_hash(F.col("tokens")))


def _hashed(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: hashlib.sha256(_short(t).tobytes()).hexdigest())


def _short(tokens) -> np.ndarray:
    t = np.asarray(tokens, np.int64)
    if len(t) and t.max() > 0xFFFF:
        raise ValueError("a token number needs more than 16 bits")
    return t.astype("<u2")


def tokens_hash(tokens: Column) -> Column:
    return F.pandas_udf(_hashed, "string", F.PandasUDFType.SCALAR)(tokens)


def iter_docs(shards_: DataFrame, split: str) -> DataFrame:
    """id, pos, lane, provenance_tier, tokens (without frame) of the documents of a split."""
    each = shards_.where(F.col("split") == split).select("lane", "tokens", F.explode("docs").alias("d"))
    return each.select("d.id", "d.pos", "lane", "d.provenance_tier", F.expr("slice(tokens, d.start + 2, d.length - 2)").alias("tokens"))


def shard_index(shards_: DataFrame) -> DataFrame:
    """split, lane (null: all), shards, docs, tokens: totals by split, by lane, and over all."""
    both = shards_.groupingSets([["split"], ["lane"], []], "split", "lane")
    return both.agg(F.count("*").alias("shards"), F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))


def verify_shards(shards_: DataFrame, index: DataFrame) -> DataFrame:
    """shard_id, ok: whether tokens still hash to what the index (shard_id, hash, n_tokens) says."""
    slim_batches(index.sparkSession)
    said = index.select("shard_id", F.col("hash").alias("said"), F.col("n_tokens").alias("said_n"))
    own = shards_.select("shard_id", tokens_hash(F.col("tokens")).alias("now"), F.size("tokens").alias("n"))
    return said.join(own, "shard_id", "left").select("shard_id", (F.col("said").eqNullSafe(F.col("now")) & F.col("said_n").eqNullSafe(F.col("n"))).alias("ok"))


def write_shards(shards_: DataFrame, path: str) -> None:
    """path/shards: little-endian 16-bit tokens of each shard as bytes, beside its manifest; path/index: the manifests alone."""
    slim_batches(shards_.sparkSession)
    as_bytes = F.pandas_udf(lambda t: t.map(lambda x: _short(x).tobytes()), "binary", F.PandasUDFType.SCALAR)
    shards_.withColumn("tokens", as_bytes("tokens")).write.mode("overwrite").parquet(f"{path}/shards")
    shards_.sparkSession.read.parquet(f"{path}/shards").drop("tokens").write.mode("overwrite").parquet(f"{path}/index")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """What write_shards wrote, with tokens as numbers again."""
    slim_batches(spark)
    numbers = F.pandas_udf(lambda t: t.map(lambda x: np.frombuffer(x, "<u2").astype(np.int32)), "array<int>", F.PandasUDFType.SCALAR)
    return spark.read.parquet(f"{path}/shards").withColumn("tokens", numbers("tokens"))


def loss_mask(segments: Column) -> Column:
    """1 where a place isn't padding and the next place is of the same document."""
    following = F.concat(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.array(F.lit(-2)))
    return F.zip_with(segments, following, lambda a, b: F.when((a != -1) & (a == b), 1).otherwise(0))


def attention_mask(segments: Column) -> Column:
    """Rows of who may look at whom: earlier places or itself, of the same document, no padding. For a sequence on demand."""
    return F.transform(segments, lambda a, i: F.transform(segments, lambda b, j: (j <= i) & (a == b) & (a != -1)))


def attended(segments: Column) -> Column:
    """How many places the attention mask of a sequence lets its places look at. n places of a segment have n * (n + 1) / 2
    such pairs wherever they lie, so the mask isn't made for it."""
    start = F.struct(F.lit(-1).alias("of"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))

    def add(s: Column, x: Column) -> Column:
        n = F.when(x == s.of, s.n + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("of"), n.alias("n"), (s.total + n).alias("total"))

    return F.aggregate(F.sort_array(F.filter(segments, lambda x: x != -1)), start, add, lambda s: s.total)


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, pad: int = PAD, keys: tuple[str, ...] = (), chunk: bool = False) -> DataFrame:
    """seq, lane, tokens, position_ids, segment_ids, loss_mask, doc_ids, n_real of sequences of a fixed length.

    docs: id, pos, lane, tokens. A document is cut at seq_len, as a default; chunk=True parts it into pieces instead, so
    that no token is lost. keys: pack within these columns instead of over the whole table.
    """
    cut = docs.select("id", "pos", F.lit(0).alias("piece"), "lane", F.slice("tokens", 1, seq_len).alias("tokens"))
    if chunk:
        parts = F.expr(f"transform(sequence(0, greatest(size(tokens) - 1, 0), {seq_len}), s -> slice(tokens, s + 1, {seq_len}))")
        cut = docs.select("id", "pos", "lane", F.posexplode(parts).alias("piece", "tokens"))
        cut = positions(cut.withColumnRenamed("pos", "doc_"), "doc_", "piece").drop("doc_")
    cut = cut.where(F.size("tokens") > 0)
    placed = cut.join(bins(cut.select(*keys, "pos", F.size("tokens").alias("n")), list(keys), seq_len).drop("n", *keys), "pos")
    rows = placed.groupBy(*keys, "bin").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "lane", "tokens"))).alias("rows"))
    lane = [] if "lane" in keys else [F.col("rows")[0].lane.alias("lane")]
    joined = F.flatten(F.transform("rows", lambda r: r.tokens))
    fill = lambda c, value: F.concat(c, F.array_repeat(F.lit(value), F.lit(seq_len) - F.size(c)))
    places = F.flatten(F.transform("rows", lambda r: F.sequence(F.lit(0), F.size(r.tokens) - 1)))
    segments = F.flatten(F.transform("rows", lambda r, i: F.array_repeat(i, F.size(r.tokens))))
    out = rows.select(*keys, *lane, F.col("bin").alias("seq"), fill(joined, pad).alias("tokens"), fill(places, 0).alias("position_ids"), fill(segments, -1).alias("segment_ids"), F.transform("rows", lambda r: r.id).alias("doc_ids"), F.size(joined).cast("long").alias("n_real"))
    return out.withColumn("loss_mask", loss_mask(F.col("segment_ids")))


def pack_pair(pairs: DataFrame, seq_len: int = SEQ_LEN, pad: int = PAD) -> DataFrame:
    """id, tokens, position_ids, segment_ids, loss_mask, cont_start, cont_end of prefix and continuation; only places that
    predict the continuation are scored."""
    both = F.slice(F.concat("prefix_tokens", "cont_tokens"), 1, seq_len)
    start = F.greatest(F.least(F.size("prefix_tokens"), F.lit(seq_len)) - 1, F.lit(0))
    n = F.size(both)
    place = F.sequence(F.lit(0), F.lit(seq_len - 1))
    return pairs.select("id", F.concat(both, F.array_repeat(F.lit(pad), F.lit(seq_len) - n)).alias("tokens"), F.transform(place, lambda i: F.when(i < n, i).otherwise(0)).alias("position_ids"), F.transform(place, lambda i: F.when(i < n, 0).otherwise(-1)).alias("segment_ids"), F.transform(place, lambda i: F.when((i >= start) & (i < n - 1), 1).otherwise(0)).alias("loss_mask"), start.alias("cont_start"), (n - 1).alias("cont_end"))


def packing_report(docs: DataFrame, sequences: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """One row: sequences, capacity, real, padding and truncated tokens, places that count, efficiency and yield."""
    of = sequences.agg(F.count("*").alias("n_sequences"), F.sum("n_real").alias("real_tokens"), F.sum(F.expr("aggregate(loss_mask, 0, (s, x) -> s + x)")).alias("loss_positions"))
    out = of.crossJoin(docs.agg(F.sum(F.size("tokens")).alias("offered")))
    capacity = F.col("n_sequences") * seq_len
    return out.select("n_sequences", capacity.alias("capacity_tokens"), "real_tokens", (capacity - F.col("real_tokens")).alias("padding_tokens"), (F.col("offered") - F.col("real_tokens")).alias("truncated_tokens"), "loss_positions", F.round(F.col("real_tokens") / capacity, 6).alias("packing_efficiency"), F.round(F.col("real_tokens") / F.col("offered"), 6).alias("token_yield"))
