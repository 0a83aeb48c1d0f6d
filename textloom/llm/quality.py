"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are the only inputs of a score. Trees are grown on binned statistics of a bounded sample of
labelled rows (TRAIN_ROWS, those with the smallest hashes of their ids) and flattened into arrays; all trees are walked
at once, a level at a time, by numpy indexing.

Defined cases: a null text is the empty text and has a score; a document without label is scored alike; of several
labels of a document the smallest counts, null labels don't; without labels every score is 0.5; repeated rows score
alike; null ids are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import body, remainder, slim_batches, table

FOLDS, TEST = 3, 1
#: Labelled rows from which the trees learn, at most.
TRAIN_ROWS = 20_000
SIGNS = b"!|*&%$#@<>{}[]()=+_~^/\\\"'.,;:-?"
NAMES = ["log_chars", "log_words", "word_length", "upper", "lower", "digit", "space", "high", "distinct", "top_word", "repeats", "line_words", "distinct_lines", "short_lines", "bad_lines", "all_caps", "sign_words", "sentence_words"]


def statistics(text: str) -> list[float]:
    """NAMES, then the share of each of SIGNS among the bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    held = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(len(words), 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    of_lines = max(len(lines), 1)
    signs = np.frombuffer(SIGNS, np.uint8)
    letters = held[65:91].sum() + held[97:123].sum() + held[128:].sum()
    bad = sum(1 for x in lines if 20 * (x.count(b"!") + x.count(b"|") + x.count(b"*") + x.count(b"&") + x.count(b"$") + x.count(b"%") + x.count(b"#")) > len(x))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), (n - held[32] - held[10]) / m, held[65:91].sum() / n, held[97:123].sum() / n, held[48:58].sum() / n, (held[32] + held[9:14].sum()) / n, held[128:].sum() / n,
        len(counts) / m, max(counts.values(), default=0) / m, sum(map(bytes.__eq__, words[1:], words)) / m, len(words) / of_lines, len(set(lines)) / of_lines, sum(len(x) < 30 for x in lines) / of_lines, bad / of_lines,
        sum(map(bytes.isupper, words)) / m, (n - letters - held[32] - held[10]) / m, len(words) / max(held[46] + held[33] + held[63], 1),
        *(held[signs] / n),
    ]


class Trees:
    """Gradient-boosted trees for a 0/1 label, as flat arrays: node k of tree t lies at row t, column k."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, base: float, depth: int):
        self.feature, self.cut, self.value, self.base, self.depth = feature, cut, value, base, depth

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Trees:
        if not len(y):
            return cls(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), 0.0, 0)
        mean = np.clip(y.mean(), 0.01, 0.99)
        base = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], 1)
        flat = binned + np.arange(x.shape[1]) * bins
        nodes, raw = 2 ** (depth + 1) - 1, np.full(len(y), base)
        feature, cut, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
        for t in range(trees):
            p = 1 / (1 + np.exp(-raw))
            slope, curve = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, wide = 2**level - 1, 2**level
                place = ((at - first)[:, None] * x.shape[1] * bins + flat).ravel()
                hist = [np.bincount(place, np.repeat(w, x.shape[1]), wide * x.shape[1] * bins).reshape(wide, x.shape[1], bins).cumsum(2) for w in (slope, curve, np.ones(len(y)))]
                whole = [h[:, :1, -1:] for h in hist]
                rest = [w - h for w, h in zip(whole, hist, strict=True)]
                gain = hist[0] ** 2 / (hist[1] + ridge) + rest[0] ** 2 / (rest[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
                gain = np.where((hist[2] >= least) & (rest[2] >= least), gain, 0).reshape(wide, -1)
                best = gain.argmax(1)
                for k in range(wide):
                    if gain[k, best[k]] > 1e-6:
                        f, b = divmod(int(best[k]), bins)
                        if b < len(edges[f]):
                            feature[t, first + k], cut[t, first + k] = f, edges[f][b]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > cut[t, at])
            own = slice(2**depth - 1, None)
            sums = [np.bincount(at - own.start, w, 2**depth) for w in (slope, curve)]
            value[t, own] = rate * sums[0] / (sums[1] + ridge)
            raw += value[t, at]
        return cls(feature, cut, value, base, depth)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row."""
        if not len(self.feature):
            return np.full(len(x), 0.5)
        tree, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.cut[tree, at])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, at].sum(1))))

    def chances(self, texts: pd.Series, rows: int = 2000) -> np.ndarray:
        """Chance of label 1 of each whole text; so many texts are walked at once."""
        return np.concatenate([self.predict(_measured(texts.iloc[at : at + rows])) for at in range(0, len(texts), rows)] or [np.zeros(0)])


def _measured(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(len(texts), len(NAMES) + len(SIGNS))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from the labelled rows outside the held-out fold; at most ``rows`` of them, the same ones each time."""
    sample = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(remainder(FOLDS) != TEST).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": list(_measured(batch["text"]))})

    joined = docs.select(F.col("doc_id").cast("long"), body().alias("text")).join(F.broadcast(sample.select(F.col("doc_id").cast("long"), "quality")), "doc_id")
    got = joined.mapInPandas(measure, "doc_id long, quality int, x array<double>")
    # Rows that repeat an id can't make the sample larger than its bound.
    got = got.orderBy("doc_id", F.xxhash64("x")).limit(rows).toPandas()
    return Trees.fit(np.array(got["x"].tolist()).reshape(len(got), -1), got["quality"].to_numpy(float))


def scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    parts = (trees.feature, trees.cut, trees.value, trees.base, trees.depth)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Trees(*parts)
        for batch in batches:
            chance = own.chances(batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": chance, "predicted": (chance >= 0.5).astype(np.int32)})

    source = docs.select(F.col("doc_id").cast("long"), (remainder(FOLDS) == TEST).alias("held_out"), body().alias("text"))
    return source.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with docs' columns: one pass, no join, nothing shuffled."""
    trees = learn(docs, labels)
    parts = (trees.feature, trees.cut, trees.value, trees.base, trees.depth)

    def chances(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Trees(*parts)
        for texts in batches:
            yield pd.Series(own.chances(texts))

    slim_batches(docs.sparkSession)
    score = F.pandas_udf(chances, "double", F.PandasUDFType.SCALAR_ITER)
    return docs.where(score(body()) >= 0.5)
