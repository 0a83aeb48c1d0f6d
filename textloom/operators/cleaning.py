"""Cleaning stages: exact and near duplicates, quality, personal data, contamination."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.sources.tables import slim_batches, written

# Fixed values of the quality rule, the contamination rule and the near-duplicate signature.
MIN_CHARS, MIN_WORDS, MAX_SYMBOLS, MAX_REPETITION = 20, 5, 0.5, 0.6
GRAM, MIN_OVERLAP, MAX_DOC_FREQ, REPORTED = 13, 1, 0.30, 5
PERMUTATIONS, BANDS, SHINGLE, THRESHOLD, SIGNATURE_SEED = 32, 16, 3, 0.8, "v5-near-dedup-2026"
PRIME = (1 << 61) - 1
#: Band keys that one task counts; rows that meet others, or their signatures, in one task.
KEYS_A_TASK, PAIRS_A_TASK = 1_000_000, 100_000
#: Bytes of text whose runs one task counts.
TEXT_A_TASK = 16 << 20
#: Rows of narrow tables that may be broadcast; edges that one task may finish.
INDEXED, LOCAL_EDGES = 500_000, 500_000
_words, _space = re.compile(rf"[\w{X.MARKS}]+").findall, re.compile(rb" ")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """id, hash, survivor (the first id with the same text, by pos) of every document. Minima combine before the shuffle,
    so a text with very many copies costs one row a task."""
    hashed = docs.select("id", "pos", X.content_hash(F.col("text")).alias("hash"))
    return hashed.join(hashed.groupBy("hash").agg(F.min_by("id", "pos").alias("survivor")), "hash").select("id", "hash", "survivor")


def distinct_texts(docs: DataFrame) -> DataFrame:
    first = docs.groupBy(X.content_hash(F.col("text")).alias("hash")).agg(F.min_by("id", "pos").alias("id"))
    return docs.join(first.select("id"), "id", "left_semi")


def _word_counts(texts: pd.Series) -> pd.DataFrame:
    """Words of each text, and how often its commonest comes, in lower case."""
    found = [_words(t or "") for t in texts]
    return pd.DataFrame({"n_words": [len(w) for w in found], "top": [max(Counter(map(str.lower, w)).values(), default=0) for w in found]})


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """id, n_chars, n_words, symbol_ratio, repetition, reason (null: the document passes); the first rule broken counts.

    Words are counted within their text, an Arrow batch at a time, so nothing is shuffled.
    """
    slim_batches(docs.sparkSession)
    stripped = F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "")
    solid = F.regexp_replace("stripped", r"(?U)\s+", "")
    counts = F.pandas_udf(_word_counts, "n_words long, top long", F.PandasUDFType.SCALAR)
    facts = docs.select("id", stripped.alias("stripped"), counts("text").alias("w")).select("id", F.length("stripped").cast("long").alias("n_chars"), "w.n_words", "w.top", solid.alias("solid"))
    facts = facts.withColumns({"n_solid": F.length("solid"), "n_symbols": F.length(F.regexp_replace("solid", X.WORD, ""))})
    symbols = F.when(F.col("n_solid") > 0, F.col("n_symbols") / F.col("n_solid")).otherwise(0.0)
    repetition = F.when(F.col("n_words") > 0, F.col("top") / F.col("n_words")).otherwise(0.0)
    reason = F.when(F.col("n_chars") < MIN_CHARS, "too short").when(F.col("n_words") < MIN_WORDS, "too few words").when(symbols > MAX_SYMBOLS, "symbol-heavy").when(repetition > MAX_REPETITION, "repetitive")
    return facts.select("id", "n_chars", "n_words", F.round(symbols, 6).alias("symbol_ratio"), F.round(repetition, 6).alias("repetition"), reason.alias("reason"))


def scrubbed(docs: DataFrame) -> DataFrame:
    """docs with personal data masked, and how much was."""
    return docs.withColumn("redactions", X.redactions(F.col("text"))).withColumn("text", X.scrub(F.col("text")))


def document_grams(docs: DataFrame, n: int = GRAM) -> DataFrame:
    """id, gram: each document's distinct runs of n lower-case words."""
    # Words are a column of their own before runs are cut from it; within the cut they would be found anew for each run.
    tokens = docs.select("id", F.transform(X.words(F.col("text")), F.lower).alias("w"))
    return tokens.select("id", F.explode(F.array_distinct(X.grams(F.col("w"), n))).alias("gram"))


def gram_hashes(docs: DataFrame, n: int = GRAM) -> DataFrame:
    """id, h: hashes of all runs of n lower-case words of each document."""
    tokens = docs.select("id", F.transform(X.words(F.col("text")), F.lower).alias("w")).where(F.size("w") >= n)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, n)))
    return tokens.select("id", F.explode(runs).alias("h"))


def gram_frequencies(docs: DataFrame, n: int = GRAM) -> DataFrame:
    """df, grams: how many runs of n words come in how many documents.

    A run goes as two 64-bit hashes of different seeds, and is counted where it arrives: most come once, so counts made
    before would hold them all in memory for nothing. Each task counts the runs of some 16 MB of text.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT_A_TASK))
    hashed = document_grams(docs, n).select(F.xxhash64("gram").alias("a"), F.xxhash64(F.lit(n), "gram").alias("b"))
    counts = hashed.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("df"))
    return counts.groupBy("df").agg(F.count("*").alias("grams"))


def pair_texts(pairs: DataFrame) -> DataFrame:
    """id, text: both texts of each contrastive pair, of one id."""
    both = F.array(*[F.concat_ws(" ", "prefix", c) for c in ("y_plus", "y_minus")])
    return pairs.select("id", F.explode(both).alias("text"))


def contamination_index(held: DataFrame, n: int = GRAM, max_doc_freq: float = MAX_DOC_FREQ, pairs: DataFrame | None = None) -> DataFrame:
    """gram, sources: runs of the evaluation texts, and of contrastive pairs, that at most the given share of them has.

    Runs are counted first; only those that are rare enough gather their sources.
    """
    texts = held.select("id", "text")
    if pairs is not None:
        texts = texts.unionByName(pair_texts(pairs))
    cap = max(1, int(max_doc_freq * texts.select("id").distinct().count()))
    grams = written(document_grams(texts, n).distinct())
    rare = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("gram")
    return grams.join(rare, "gram").groupBy("gram").agg(F.sort_array(F.collect_set("id")).alias("sources"))


def contaminated(docs: DataFrame, held: DataFrame, n: int = GRAM, min_overlap: int = MIN_OVERLAP, max_doc_freq: float = MAX_DOC_FREQ, symmetric: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """id, overlap, matched_sources (the first few), sample_ngram of documents that share runs with evaluation texts.

    Documents send hashes of their runs; those that meet a hash of the index spell out their runs, which are then compared
    as text. symmetric=True normalises and masks the evaluation texts like the documents; else they are matched as they are.
    """
    if symmetric:
        held = held.withColumn("text", X.scrub(X.normalize(F.col("text"))))
    index = written(contamination_index(held, n, max_doc_freq, pairs))
    hashes = index.select(F.xxhash64(F.split("gram", " ")).alias("h"))
    hashes = F.broadcast(hashes) if index.limit(INDEXED + 1).count() <= INDEXED else hashes
    near = written(gram_hashes(docs, n).join(hashes, "h", "left_semi").select("id").distinct())
    near = F.broadcast(near) if near.limit(INDEXED + 1).count() <= INDEXED else near
    hits = written(document_grams(docs.join(near, "id", "left_semi"), n).join(index, "gram"))
    matched = hits.select("id", F.explode("sources").alias("s")).distinct()
    first = matched.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("s"))).where(F.col("k") <= REPORTED)
    first = first.groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("matched_sources"))
    of = hits.groupBy("id").agg(F.countDistinct("gram").alias("overlap"), F.min("gram").alias("sample_ngram")).where(F.col("overlap") >= min_overlap)
    return of.join(first, "id").select("id", "overlap", "matched_sources", "sample_ngram")


# Near duplicates

_rng = random.Random(SIGNATURE_SEED)
COEFFICIENTS = [(_rng.randrange(1, PRIME), _rng.randrange(0, PRIME)) for _ in range(PERMUTATIONS)]


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def signatures_of(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes (below 2^32) from one start to the next: the least of a * h + b modulo the prime for each
    coefficient pair, by 64-bit arithmetic; the prime for an empty run."""
    out = np.full((len(starts), PERMUTATIONS), PRIME, np.int64)
    sizes = np.diff(np.r_[starts, len(hashes)])
    held = sizes > 0
    if not len(hashes):
        return out
    h = hashes.astype(np.uint64)
    for k, (a, b) in enumerate(COEFFICIENTS):
        high = _folded(np.uint64(a >> 31) * h)
        shifted = _folded(((high & np.uint64((1 << 30) - 1)) << np.uint64(31)) + (high >> np.uint64(30)))
        low = _folded(np.uint64(a & 0x7FFFFFFF) * h)
        values = _folded(_folded(shifted + low) + np.uint64(b))
        out[held, k] = np.minimum.reduceat(values, starts[held]).astype(np.int64)
    return out


def shingle_hashes(text: str) -> list[int]:
    """CRC-32 of the text's runs of lower-case words, repeats included; of fewer words the whole sequence is one."""
    tokens = " ".join(_words(text)).lower().encode("utf-8", "surrogatepass")
    cuts = [-1, *[m.start() for m in _space.finditer(tokens)], len(tokens)]
    if not tokens:
        return []
    last = max(1, len(cuts) - SHINGLE)
    return [zlib.crc32(tokens[cuts[i] + 1 : cuts[min(i + SHINGLE, len(cuts) - 1)]]) for i in range(last)]


def signatures(docs: DataFrame) -> DataFrame:
    """id, pos, sig: MinHash of the lower-case word shingles; all shingles of some documents are hashed at once."""

    slim_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                own = [shingle_hashes(t or "") for t in part["text"]]
                sizes = np.array([len(x) for x in own], np.int64)
                sigs = signatures_of(np.array([h for x in own for h in x], np.uint64), np.cumsum(sizes) - sizes)
                yield pd.DataFrame({"id": part["id"], "pos": part["pos"], "sig": list(sigs)})

    return docs.select("id", "pos", "text").mapInPandas(run, "id string, pos long, sig array<long>")


def similar_pairs(sigs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """early, late (pos), est: signatures that share a band and agree in the threshold's share of slots. sigs: pos, sig,
    distinct. Pairs meet by band as numbers only, each once; signatures come to them after that."""
    rows = PERMUTATIONS // BANDS
    banded = sigs.select("pos", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * rows + 1, rows)))).alias("key"))
    # Keys are dealt before they are counted: most come once, so counts made before that would all be held by one task.
    parts, n = int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sigs.count()
    banded = banded.repartition(max(parts, -(-n * BANDS // KEYS_A_TASK)), "key").withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("key", "pos")
    banded = written(banded)
    a, b = banded.select("key", F.col("pos").alias("early")), banded.select("key", F.col("pos").alias("late"))
    a = a.repartition(max(parts, -(-banded.count() // PAIRS_A_TASK)), "key")
    pairs = written(a.join(b, "key").where("early < late").select("early", "late").distinct())
    pairs = pairs.repartition(max(parts, -(-(pairs.count() + n) // PAIRS_A_TASK)), "early")
    est = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x)) / PERMUTATIONS
    pairs = pairs.join(sigs.select(F.col("pos").alias("early"), F.col("sig").alias("sig_a")), "early").join(sigs.select(F.col("pos").alias("late"), F.col("sig").alias("sig_b")), "late")
    return pairs.withColumn("est", est).where(F.col("est") >= threshold).select("early", "late", "est")


def _first_come(edges: pd.DataFrame) -> pd.DataFrame:
    """pos, kept of every end of the edges, one after the other: kept if no earlier kept one is at an edge's other end."""
    earlier: dict[int, list[int]] = {}
    for a, b in zip(edges["early"].tolist(), edges["late"].tolist(), strict=True):
        earlier.setdefault(b, []).append(a)
        earlier.setdefault(a, [])
    kept: dict[int, bool] = {}
    for k in sorted(earlier):
        kept[k] = not any(kept[a] for a in earlier[k])
    return pd.DataFrame({"pos": list(kept), "kept": list(kept.values())})


def first_kept(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """pos, kept: the first maximal independent set in the order of pos. edges: early, late.

    A round keeps nodes without an undecided earlier neighbour and drops their later neighbours; only edges between
    undecided nodes go on. As soon as at most ``local`` edges are left, one task finishes them, so a chain of documents
    costs few rounds unless it is longer than that.
    """
    spark, left, decided = edges.sparkSession, edges.select("early", "late"), None
    add = lambda x: x if decided is None else decided.unionByName(x)
    while left.limit(local + 1).count() > local:
        heads = left.select(F.col("early").alias("pos")).distinct().join(left.select(F.col("late").alias("pos")), "pos", "left_anti")
        heads = written(heads)
        drop = written(left.join(heads.withColumnRenamed("pos", "early"), "early", "left_semi").select(F.col("late").alias("pos")).distinct())
        decided = add(heads.withColumn("kept", F.lit(True)).unionByName(drop.withColumn("kept", F.lit(False))))
        gone = written(heads.unionByName(drop))
        rest = left.join(gone.withColumnRenamed("pos", "early"), "early", "left_anti").join(gone.withColumnRenamed("pos", "late"), "late", "left_anti")
        # Nodes whose edges all lead to dropped ones are kept.
        ends = lambda e: e.select(F.col("early").alias("pos")).unionByName(e.select(F.col("late").alias("pos"))).distinct()
        free = ends(left).join(gone, "pos", "left_anti").join(ends(rest), "pos", "left_anti")
        decided = add(written(free.withColumn("kept", F.lit(True))))
        left = written(rest)
    last = left.groupBy().applyInPandas(_first_come, "pos long, kept boolean") if left.limit(1).count() else spark.createDataFrame([], "pos long, kept boolean")
    return written(add(last))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, near, est_jaccard of dropped documents: those with an earlier kept document at the threshold.

    What is kept is the first maximal independent set in the order of pos. Documents of one signature are one node, so
    copies make no pairs.
    """
    sigs = written(signatures(docs))
    nodes = written(sigs.groupBy("sig").agg(F.min("pos").alias("pos"), F.min_by("id", "pos").alias("id")))
    edges = written(similar_pairs(nodes, threshold))
    state = first_kept(edges)
    kept = edges.join(state.where("kept").select(F.col("pos").alias("early")), "early", "left_semi").join(state.where("NOT kept").select(F.col("pos").alias("late")), "late", "left_semi")
    # The likest kept document, of several the first.
    best = kept.groupBy(F.col("late").alias("first")).agg(F.max(F.struct("est", (-F.col("early")).alias("early"))).alias("b")).select("first", F.col("b.est").alias("est"), (-F.col("b.early")).alias("near_pos"))
    best = best.join(nodes.select(F.col("pos").alias("near_pos"), F.col("id").alias("near")), "near_pos")
    copies = sigs.join(nodes.select("sig", F.col("pos").alias("first"), F.col("id").alias("first_id")), "sig").select("id", "pos", "first", "first_id")
    out = copies.join(best, "first", "left").where("pos <> first OR near IS NOT NULL")
    # A copy of a kept node is as similar as can be to it; a copy of a dropped node has the node's survivor.
    return out.select("id", F.coalesce("near", "first_id").alias("near"), F.bround(F.coalesce("est", F.lit(1.0)), 4).alias("est_jaccard"))
