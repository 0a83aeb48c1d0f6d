"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates, P(w | v) = a2 c(v, w) / c(v) + a1 c(w) / N + a0 / (V + 1), with weights a
chosen by the frequency bucket of the context v. Part of the training documents (HELD of FOLDS) is deleted from the
counts, and expectation-maximisation over the exact counts of each of its tokens, a pass over the cluster a round, learns
the weights; the counts of the final model are of all training documents. The word that ends a text is an event, the place before its first word a context, and V + 1 leaves a place
for words never met, so a text's probabilities are those of a proper distribution.

Texts become chunks of word numbers once. A chunk sends the sorted hashes of its distinct words and word pairs with
their counts, in compact blocks dealt by hash range, and gets the counts of the corpus back in the same order; pairs
are dealt by a hash of both words, so a very common word or pair is one entry of each chunk. What a pair's mixture
needs meets in its chunk, and the corpus is never in one place.

Defined cases: a null text is the empty text, of one token, its end; null ids count as the empty text in the split and
are carried along; rows that repeat count and score each; without training documents the score is 0 for every text;
very long texts are scored whole; an empty table gives an empty result. Words and word pairs are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import batches_of, body, discard, remainder, settle, slim_batches, table, written

FOLDS, TEST, HELD = 7, 2, 3
#: Words and pairs in one part, about; bytes of text and documents in a chunk, about.
PART, CHUNK_BYTES, CHUNK_DOCS = 1_000_000, 10_000_000, 4000
#: Bytes of chunks that a worker holds at once.
BATCH = "12m"
END, START = b"\n", b"\n\n"
#: Rounds of expectation-maximisation at most, and the gain of log-likelihood a token below which they end.
ROUNDS, GAIN = 20, 1e-5
BUCKETS, START_WEIGHTS = 64, (0.5, 0.4, 0.1)


def planed(values: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned values, all lowest ones first, so that bytes of like distribution lie together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def packed(values: np.ndarray) -> bytes:
    """Ascending uint64 values: their number, the first, and differences of the fewest bytes. Differences of hashes have
    even low bytes, which are kept as they are; the two highest are uneven and get Huffman codes."""
    n = len(values)
    if not n:
        return n.to_bytes(4, "little")
    steps = np.diff(values)
    width = max(2, (int(steps.max() if n > 1 else 0).bit_length() + 7) // 8)
    planes, coder = planed(steps, width), zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    low = (width - 2) * (n - 1)
    return b"".join([n.to_bytes(4, "little"), bytes([width]), int(values[0]).to_bytes(8, "little"), planes[:low], coder.compress(planes[low:]), coder.flush()])


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    steps = np.zeros((n, 8), np.uint8)
    if n:
        width, low = data[4], 13 + (data[4] - 2) * (n - 1)
        planes = data[13:low] + zlib.decompress(data[low:], -15)
        steps[0] = np.frombuffer(data, np.uint8, 8, 5)
        steps[1:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n - 1).T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def slim(values: np.ndarray) -> bytes:
    """Counts in the fewest whole bytes, deflated; most are 0 or 1."""
    return zlib.compress(planed(values, max(1, (int(values.max() if len(values) else 0).bit_length() + 7) // 8)), 1)


def wide(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(planes) // n] = planes.reshape(-1, n).T
    return out.reshape(-1).view("<i8")


def chunks(docs: DataFrame) -> DataFrame:
    """Chunks of documents as numbers of their distinct words; number 0 is the end, 1 the place before the first word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, serial = TaskContext.get().partitionId() << 32, count()
        schema = ["chunk", "doc_ids", "folds", "sizes", "words", "tokens", "n"]
        for batch in batches:
            held, size = [], 0
            rows = list(zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), batch["fold"], batch["text"], strict=True))
            for k, row in enumerate(rows):
                held.append(row)
                size += len(row[2])
                if size >= CHUNK_BYTES or len(held) >= CHUNK_DOCS or k == len(rows) - 1:
                    numbers: dict[bytes, int] = defaultdict(count().__next__)
                    number = numbers.__getitem__
                    number(END), number(START)
                    own = [list(map(number, t.encode("utf-8", "surrogatepass").lower().split())) for _, _, t in held]
                    tokens = np.concatenate([np.array([*x, 0], np.int64) for x in own]).astype("<u4")
                    planes = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4).T)  # small numbers lie together
                    yield pd.DataFrame([(base | next(serial), [None if x[0] is None else int(x[0]) for x in held], np.array([x[1] for x in held], np.uint8).tobytes(), np.array([len(x) + 1 for x in own], "<u4").tobytes(), np.array([xxhash.xxh64_intdigest(w) for w in numbers], "<u8").tobytes(), zlib.compress(planes.tobytes(), 1), len(tokens))], columns=schema)
                    held, size = [], 0

    source = docs.select(F.col("doc_id").cast("long"), remainder(FOLDS).alias("fold"), body().alias("text"))
    return source.mapInPandas(run, "chunk long, doc_ids array<long>, folds binary, sizes binary, words binary, tokens binary, n long")


class Chunk:
    """Arrays of a chunk: for each token its word, the word before it and its pair; hashes of words and pairs if asked."""

    def __init__(self, row, hashed: bool = True):
        self.sizes = np.frombuffer(row.sizes, "<u4").astype(np.int64)
        self.tokens = np.ascontiguousarray(np.frombuffer(zlib.decompress(row.tokens), np.uint8).reshape(4, -1).T).reshape(-1).view("<i4")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.before = np.roll(self.tokens, 1)
        self.before[self.starts] = 1
        self.folds = np.frombuffer(row.folds, np.uint8)
        self.fold = np.repeat(self.folds, self.sizes)
        both = (self.before.astype(np.int64) << 32) | self.tokens
        order = np.argsort(both)
        both = both[order]
        new = np.r_[True, both[1:] != both[:-1]]
        self.pair_of = np.empty(len(both), np.int32)
        self.pair_of[order] = np.cumsum(new) - 1
        self.n_pairs = int(new.sum())
        if hashed:
            self.words = np.frombuffer(row.words, "<u8")
            self.order = np.argsort(self.words)
            local = both[new]
            mixed = self.words[local >> 32] * np.uint64(0x9E3779B97F4A7C15) + self.words[local & 0xFFFFFFFF]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            self.pairs = mixed
            self.pair_order = np.argsort(self.pairs)

    def counts(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the tokens chosen: how often each word and each pair comes; the place before a first word counts as a word."""
        of_words = np.bincount(self.tokens[which], minlength=len(self.words))
        of_words[1] = which[self.starts].sum()
        return of_words, np.bincount(self.pair_of[which], minlength=self.n_pairs)


def corpus_counts(table_of_chunks: DataFrame, parts_bits: int) -> DataFrame:
    """kind (0 words, 1 pairs), part, chunk, every and less: counts over the corpus of the chunk's own sorted hashes in the
    part's range, over the training documents and over those of them that are held out, mostly 0; chunk -1: totals over
    all training documents and without those held out."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift = np.uint64(64 - parts_bits)
        for batch in batches:
            for row in batch.itertuples():
                own, rows = Chunk(row), []
                train, kept = own.fold != TEST, (own.fold != TEST) & (own.fold != HELD)
                for kind, (hashes, order, a, b) in enumerate(zip((own.words, own.pairs), (own.order, own.pair_order), own.counts(train), own.counts(kept), strict=True)):
                    keys, a, b = hashes[order], a[order], b[order]
                    cuts = np.searchsorted(keys >> shift, np.arange((1 << parts_bits) + 1, dtype=np.uint64))
                    rows += [(kind, p, row.chunk, packed(keys[x:y]), slim(a[x:y]), slim((a - b)[x:y]), int(y - x)) for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
                yield pd.DataFrame(rows, columns=["kind", "part", "chunk", "keys", "every", "less", "n"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        keys = [unpacked(x) for x in group["keys"]]
        sizes = np.array([len(k) for k in keys])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate([wide(x, n) for x, n in zip(group[c], sizes, strict=True)])).astype(np.int64) for c in ("every", "less")]
        kind, part = int(group["kind"].iloc[0]), int(group["part"].iloc[0])
        back = [(kind, part, int(c), slim(sums[0][own]), slim(sums[1][own]), 0, 0, 0, 0) for c, own in zip(group["chunk"], np.split(at, np.cumsum(sizes)[:-1]), strict=True)]
        total = (kind, part, -1, b"", b"", *(int(f(s)) for s in (sums[0], sums[0] - sums[1]) for f in (lambda s: (s > 0).sum(), np.sum)))
        return pd.DataFrame([*back, total], columns=["kind", "part", "chunk", "every", "less", "v", "n", "kept_v", "kept_n"])

    sent = table_of_chunks.mapInPandas(send, "kind int, part int, chunk long, keys binary, every binary, less binary, n long")
    return sent.groupBy("kind", "part").applyInPandas(merge, "kind int, part int, chunk long, every binary, less binary, v long, n long, kept_v long, kept_n long")


def buckets(contexts: np.ndarray) -> np.ndarray:
    """0 for a context never met, else one more than the binary logarithm of its count, rounded down."""
    return np.frexp(contexts.astype(np.float64))[1]


def known(row) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts over the corpus of the chunk's words, then pairs: (all, kept), in the order of the chunk's arrays."""
    own, out = row.own, []
    for kind, order in ((0, own.order), (1, own.pair_order)):
        parts = sorted((x for x in row.found if x["kind"] == kind), key=lambda x: x["part"])
        shift, keys = np.uint64(64 - row.bits), (own.words if kind == 0 else own.pairs)[order]
        sizes = np.bincount((keys >> shift).astype(np.int64), minlength=1 << row.bits)
        both = []
        for c in ("every", "less"):
            values = np.zeros(len(order), np.int64)
            values[order] = np.concatenate([wide(x[c], int(sizes[x["part"]])) for x in parts])
            both.append(values)
        out.append((both[0], both[0] - both[1]))
    return out


def mixed(weights: np.ndarray, c_v: np.ndarray, c_w: np.ndarray, c_vw: np.ndarray, n: int, v: int) -> np.ndarray:
    """(tokens, 3): what the pair's, the word's and the uniform estimate give to each token's probability."""
    w = weights[buckets(c_v)]
    w[c_v == 0, 1] += w[c_v == 0, 0]  # a context never met has no estimate of pairs
    w[c_v == 0, 0] = 0
    return w * np.stack([c_vw / np.maximum(c_v, 1), c_w / max(n, 1), np.full(len(c_v), 1 / (v + 1))], 1)


def expected(weights: np.ndarray, counts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, v: int) -> np.ndarray:
    """Sums over held-out tokens: their shares by bucket and estimate, then their log-likelihood and number."""
    out = np.zeros(3 * BUCKETS + 2)
    for c_v, c_w, c_vw in counts:
        if len(c_v):
            shares = mixed(weights, c_v, c_w, c_vw, n, v)
            total = shares.sum(1)
            of = buckets(c_v)
            for k in range(3):
                out[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(of, shares[:, k] / total, BUCKETS)
            out[-2:] += np.log(total).sum(), len(total)
    return out


def maximised(sums: np.ndarray) -> np.ndarray:
    """The weights of each bucket: its tokens' shares; those of all buckets for one without tokens."""
    by = sums[: 3 * BUCKETS].reshape(3, BUCKETS).T
    pooled = by.sum(0) / by.sum() if by.sum() else np.array(START_WEIGHTS)
    weights = (by + 1e-3 * pooled) / (by.sum(1, keepdims=True) + 1e-3)
    return np.maximum(weights, 1e-9) / np.maximum(weights, 1e-9).sum(1, keepdims=True)


def held_counts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64).reshape(3, -1))


def em(ready: DataFrame, n: int, v: int) -> tuple[np.ndarray, list[float]]:
    """(weights by bucket, log-likelihood a token before each round). ready: held, the counts of held-out tokens."""
    weights, likelihoods = np.repeat([START_WEIGHTS], BUCKETS, 0), []
    for _ in range(ROUNDS):

        def run(batches: Iterator[pd.DataFrame], weights=weights) -> Iterator[pd.DataFrame]:
            sums = sum((expected(weights, map(held_counts, batch["held"]), n, v) for batch in batches), np.zeros(3 * BUCKETS + 2))
            yield pd.DataFrame({"at": np.arange(len(sums)), "x": sums})

        sums = np.zeros(3 * BUCKETS + 2)
        for at, x in ready.select("held").mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x")).collect():
            sums[at] = x
        if not sums[-1]:
            break
        likelihoods.append(sums[-2] / sums[-1])
        weights = maximised(sums)
        if len(likelihoods) > 1 and likelihoods[-1] - likelihoods[-2] < GAIN:
            break
    return weights, likelihoods


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    # A row holds a chunk of some megabytes; few of them are to be in a worker at once.
    with batches_of(spark, BATCH):
        whole = written(chunks(docs))
        tokens = whole.agg(F.sum("n")).first()[0] or 0
        bits = max(3, math.ceil(math.log2(tokens / PART + 1)))
        found = written(corpus_counts(whole, bits))
        settle(spark)
        v, n, kept_v, kept_n = found.where("chunk = -1 AND kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("v", "n", "kept_v", "kept_n")]).first()
        starts = starts_of(whole)
        n, kept_n, v, kept_v = n - starts[0], kept_n - starts[1], v - (starts[0] > 0), kept_v - (starts[1] > 0)

        def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    row = pd.Series(row._asdict())
                    row["own"], row["bits"] = own, row["bits"] = Chunk(row), bits
                    (words, kept_words), (pairs, kept_pairs) = known(row)
                    at = own.fold == HELD
                    held = np.concatenate([kept_words[own.before[at]], kept_words[own.tokens[at]], kept_pairs[own.pair_of[at]]])
                    yield pd.DataFrame([(row["doc_ids"], row["folds"], row["sizes"], len(own.words), row["tokens"], slim(words), slim(pairs), zlib.compress(held.astype("<u4").tobytes(), 1))], columns=["doc_ids", "folds", "sizes", "n_words", "tokens", "of_words", "of_pairs", "held"])

        own_counts = found.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("kind", "part", "every", "less")).alias("found"))
        kinds = "doc_ids array<long>, folds binary, sizes binary, n_words int, tokens binary, of_words binary, of_pairs binary, held binary"
        ready = written(whole.drop("n").join(own_counts, "chunk").mapInPandas(join, kinds))
        discard(whole, found)
        settle(spark)
        weights, _ = em(ready, kept_n, kept_v)

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                own = Chunk(row, hashed=False)
                words, pairs = wide(row.of_words, row.n_words), wide(row.of_pairs, own.n_pairs)
                c_w = words[own.tokens]
                chance = mixed(weights, words[own.before], c_w, pairs[own.pair_of], n, v).sum(1) if n else np.ones(len(c_w))
                sums = lambda x: np.add.reduceat(x, own.starts)  # noqa: B023, E731
                yield pd.DataFrame({"doc_id": pd.Series(list(row.doc_ids), dtype="Int64"), "held_out": own.folds == TEST, "n_tokens": own.sizes, "n_known": sums((c_w > 0).astype(np.int64)), "train_tokens": n, "base_score": sums(np.log10((c_w + 1) / (n + (v + 1)))), "score": sums(np.log10(chance))})

    slim_batches(spark, BATCH)
    return ready.drop("held").mapInPandas(last, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def starts_of(whole: DataFrame) -> tuple[int, int]:
    """Training documents, and those of them that aren't held out; each counts once as the place before its first word."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            folds = [np.frombuffer(x, np.uint8) for x in batch["folds"]]
            yield pd.DataFrame({"a": [int((f != TEST).sum()) for f in folds], "b": [int(((f != TEST) & (f != HELD)).sum()) for f in folds]})

    return tuple(x or 0 for x in whole.select("folds").mapInPandas(tally, "a long, b long").agg(F.sum("a"), F.sum("b")).first())


def op4_lm(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
