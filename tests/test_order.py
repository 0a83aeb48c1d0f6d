"""Order-dependent operators against sequential loops: ids of unequal length, numbers beyond ten million, clashing names."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import order as O
from textloom.operators import packing as P
from textloom.operators import planning as G
from textloom.operators import tokens as K
from textloom.sources import corpus as R


def mixed(rng, n):
    """Distinct ids whose order isn't that of their lengths."""
    return list({"".join(rng.choice("ab9z") for _ in range(rng.randint(1, 9))) for _ in range(n)})


def test_positions_of_mixed_ids(spark):
    ids = mixed(random.Random(1), 400) + ["abc9zzz", "abcd1", "ab"]
    ids = list(dict.fromkeys(ids))
    got = {r.id: r.pos for r in O.positions(spark.createDataFrame([(i, 0) for i in ids], "id string, part_ int").repartition(5), "id").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}


def test_selection_over_mixed_ids(spark):
    """What the first of two documents takes isn't left for the second, whatever the lengths of their ids."""
    limits = spark.createDataFrame([("a", 10, 0), ("b", 300, 40)], "lane string, target long, floor long")
    two = spark.createDataFrame([("abc9zzz", "a", 10, 0.9, 0.0), ("abcd1", "a", 10, 0.9, 0.0)], "id string, lane string, tokens long, quality double, delta_s double")
    assert {r.id: r.decision for r in G.select(two, limits).collect()} == {"abc9zzz": "accept", "abcd1": "reject"}
    rng = random.Random(2)
    cand = [(i, "b", rng.randint(1, 9), rng.choice([0.1, 0.3, 0.9]), rng.choice([-2.0, 0.0, 1.0])) for i in mixed(rng, 300)]
    used, want = 0, {}
    for i, _, n, q, ds in sorted(cand):
        score = max(0.0, min(1.0, q + 0.3 * ds))
        want[i] = "accept" if used < 40 else "reject" if used >= 300 else "accept" if score >= 0.5 else "defer" if score >= 0.2 else "reject"
        used += n * (want[i] == "accept")
    got = G.select(spark.createDataFrame(cand, "id string, lane string, tokens long, quality double, delta_s double").repartition(6), limits)
    assert {r.id: r.decision for r in got.collect()} == want


def test_ids_beyond_seven_digits(spark, tmp_path):
    ids = [1, 9_999_999, 10_000_000, 12_345_678, 123_456_789, 12_345_670]
    spark.createDataFrame([(i, f"text {i}", "en", "src00", 9) for i in ids], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.id, r.pos) for r in R.corpus(spark, str(tmp_path)).collect()}
    assert len({x for x, _ in got.values()}) == len(ids)
    assert got[12_345_678] == ("src00-12345678", 12_345_678) and got[1][0] == "src00-0000001"


@pytest.mark.parametrize("least", [1, 1000])
def test_sums_and_prefixes_equal_a_loop(spark, monkeypatch, least):
    monkeypatch.setattr(O, "LEAST", least)
    rng = random.Random(3)
    rows = [(pos, rng.choice(["x", "y", None]), rng.randint(1, 9), 0, 0) for pos in rng.sample(range(-50, 20_000_000), 200)]
    df = spark.createDataFrame(rows, "pos long, lane string, n long, bucket_ int, before_ int").repartition(4)
    total, want, kept = {}, {}, set()
    for pos, lane, n, *_ in sorted(rows):
        want[pos] = total.get(lane, 0)
        if want[pos] < 100:
            kept.add(pos)
        total[lane] = want[pos] + n
    got = O.sums_before(df, ["lane"], "pos", sum_=F.col("n"))
    assert got.columns == [*df.columns, "sum_"] and {r.pos: r.sum_ for r in got.collect()} == want
    assert {r.pos for r in R.capped_prefix(df, ["lane"], "pos", "n", F.lit(100)).collect()} == kept
    assert O.sums_before(df.limit(0), ["lane"], "pos", sum_=F.col("n")).count() == 0


@pytest.mark.parametrize("least", [2, 1000])
def test_bins_equal_next_fit(spark, monkeypatch, least):
    monkeypatch.setattr(O, "LEAST", least)
    rng = random.Random(4)
    rows = [(k, pos, rng.choice([1, 2, 3, 7, 30])) for k in ("x", "y", None) for pos in rng.sample(range(400), 60)]
    df = spark.createDataFrame(rows, "lane string, pos long, n int").repartition(3)
    want = {}
    for lane in ("x", "y", None):
        own = sorted((p, n) for k, p, n in rows if k == lane)
        want |= {(lane, p): b for (p, _), b in zip(own, P.next_fit(np.array([n for _, n in own]), 10).tolist(), strict=True)}
    assert {(r.lane, r.pos): r.bin for r in P.bins(df, ["lane"], 10).collect()} == want
    assert P.bins(df.limit(0), ["lane"], 10).count() == 0


@given(st.lists(st.sampled_from([0, 1, 2, 5, 9, 25]), min_size=1, max_size=40), st.integers(3, 20), st.lists(st.integers(0, 39), max_size=4))
@settings(max_examples=200, deadline=None)
def test_blocks_chain_to_next_fit(lengths, cap, cuts):
    lengths = np.array(lengths)
    parts = [x for x in np.split(lengths, sorted(c for c in cuts if c < len(lengths))) if len(x)]
    sums = pd.DataFrame([P.block_exits(x, cap) for x in parts], columns=["low", "new", "used", "total"])
    got = [b for x, (bin_, used) in zip(parts, P.chain_blocks(sums, cap), strict=True) for b in P.next_fit(x, cap, bin_, used).tolist()]
    assert got == P.next_fit(lengths, cap).tolist()


def plain_merges(counts, size):
    """Counts all pairs anew for each merge."""
    vocab = {t: k for k, t in enumerate((*K.SPECIALS, *K.SYMBOLS))}
    words, merges = [(K.to_symbols(w), n) for w, n in counts.items()], []
    while len(vocab) < size:
        held = {}
        for w, n in words:
            for p in zip(w, w[1:], strict=False):
                held[p] = held.get(p, 0) + n
        held = {p: n for p, n in held.items() if p[0] + p[1] not in vocab}
        if not held:
            break
        a, b = min(p for p, n in held.items() if n == max(held.values()))
        words = [(plain_word(w, [(a, b)]), n) for w, n in words]
        vocab[a + b] = len(vocab)
        merges.append((a, b))
    return vocab, merges


def plain_word(symbols, merges):
    for a, b in merges:
        out, at = [], 0
        while at < len(symbols):
            step = 2 if symbols[at : at + 2] == [a, b] else 1
            out.append("".join(symbols[at : at + step]))
            at += step
        symbols = out
    return symbols


@given(st.dictionaries(st.text("abc é", min_size=1, max_size=8), st.integers(1, 5), min_size=1, max_size=20), st.text("abc é", max_size=40))
@settings(max_examples=60, deadline=None)
def test_merges_equal_a_plain_trainer(counts, text):
    vocab, merges = K.learn_merges(counts, 290)
    assert (vocab, merges) == plain_merges(counts, 290)
    assert K.merge_word(text, {m: k for k, m in enumerate(merges)}) == plain_word(K.to_symbols(text), merges)
    assert not K.integrity(vocab, merges)


def test_a_long_run_without_white_space_merges_in_time():
    _, merges = K.learn_merges({"abababab": 5, "aabb": 2}, 264)
    assert len(K.merge_word("ab" * 50_000, {m: k for k, m in enumerate(merges)})) < 50_000
