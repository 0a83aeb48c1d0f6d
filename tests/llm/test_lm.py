"""LM scoring against a plain model of the same counts, weights by expectation-maximisation, proper distributions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from textloom.llm import lm

SCHEMA = "doc_id long, text string, held string, found int, n long"


def texts(rng):
    rows = [(k, " ".join(rng.choice(["a", "b", "the", "cat", "Dog", "ran", f"w{rng.randrange(60)}"]) for _ in range(rng.choice([0, 1, 5, 40])))) for k in range(260)]
    return [*rows, (260, None), (261, ""), (262, " \t\n"), (263, "the cat " * 5000), (None, "the Dog ran"), (5, rows[5][1]), (264, "a　b A é É")]


def plain(rows, weights=None):
    """doc_id, held_out, n_tokens, n_known, N, base, score of each row, by dictionaries."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: [x for x in re.split("[ \t-\r]+", (t or "").translate(low)) if x] + [0]
    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7
    one, two, starts = Counter(), Counter(), 0
    for i, t in rows:
        if fold(i) != 2:
            w = words(t)
            one.update(w)
            two.update(zip([1, *w], w, strict=False))
            starts += 1
    n, v, context = sum(one.values()), len(one), Counter(one)
    context[1] = starts
    out = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = None
        if weights is not None:
            score = 0.0
            for a, b in zip([1, *w], w, strict=False):
                x = list(weights[int(lm.buckets(np.array([context[a]]))[0])])
                if not context[a]:
                    x = [0, x[0] + x[1], x[2]]
                score += math.log10(x[0] * two[a, b] / max(1, context[a]) + x[1] * one[b] / n + x[2] / (v + 1))
        out.append((i, fold(i) == 2, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


@pytest.fixture
def seen(monkeypatch):
    kept = {}
    own = lm.em

    def em(*args):
        kept["weights"], kept["likelihoods"] = own(*args)
        return kept["weights"], kept["likelihoods"]

    monkeypatch.setattr(lm, "em", em)
    return kept


@pytest.mark.parametrize("chunk", [4000, 7])
def test_scores_equal_a_plain_model(spark, monkeypatch, seen, chunk):
    monkeypatch.setattr(lm, "CHUNK_DOCS", chunk)
    rows = texts(random.Random(1))
    docs = spark.createDataFrame([(i, t, "x", 0, 0) for i, t in rows], SCHEMA).repartition(3)
    got = lm.score(docs).collect()
    want = plain(rows, seen["weights"])
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)
    rising = seen["likelihoods"]
    assert len(rising) > 2 and all(y >= x - 1e-9 for x, y in zip(rising, rising[1:], strict=False))


def test_weights_beat_their_start_and_every_context_sums_to_one():
    rng = np.random.default_rng(2)
    words = rng.choice(20, 3000, p=np.r_[np.full(10, 0.09), np.full(10, 0.01)])
    one, two = np.bincount(words, minlength=21), np.zeros((21, 21), int)
    np.add.at(two, (words[:-1], words[1:]), 1)
    context = two.sum(1)
    n, v = int(one.sum()), 20
    held = [(context[a : a + 1], one[b : b + 1], two[a, b : b + 1]) for a, b in rng.integers(0, 21, (200, 2))]
    weights, last = np.repeat([lm.START_WEIGHTS], lm.BUCKETS, 0), -np.inf
    for _ in range(10):
        sums = lm.expected(weights, iter(held), n, v)
        assert sums[-2] >= last - 1e-9 and sums[-1] == 200
        last, weights = sums[-2], lm.maximised(sums)
    assert np.allclose(weights.sum(1), 1)
    for a in range(21):  # word 20 is the one never met: V words and it make up the whole
        every = lm.mixed(weights, np.full(21, context[a]), one, two[a], n, v).sum()
        assert every == pytest.approx(1)


def test_without_documents_or_training(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm.score(empty).count() == 0
    test = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == lm.TEST)
    (row,) = lm.score(spark.createDataFrame([(test, "never seen", "x", 0, 0)], SCHEMA)).collect()
    assert row.held_out and row.n_known == 0 and row.train_tokens == 0 and row.score == 0


def test_hashes_and_counts_come_back_from_their_bytes():
    """None, one, neighbours, the largest values, and widths from one byte to eight."""
    rng = np.random.default_rng(5)
    top = np.uint64(2**64 - 1)
    for n in (0, 1, 2, 3, 300, 50_000):
        for bits in (3, 8, 20, 47, 64):
            values = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True) >> np.uint64(64 - bits))
            assert (lm.unpacked(lm.packed(values)) == values).all()
    assert (lm.unpacked(lm.packed(np.array([0, top], np.uint64))) == [0, top]).all()
    for values in ([], [0], [1, 0, 255], [256, 0], [70_000, 1], [2**33, 7]):
        assert lm.wide(lm.slim(np.array(values, np.int64)), len(values)).tolist() == values
