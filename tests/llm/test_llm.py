"""The ten operators against brute force on small fixtures, with nulls, empty texts, ties, repeats and empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from textloom.llm import bpe, exact_dedup, line_dedup, mixing, quality, simhash, topk

SCHEMA = "doc_id long, text string, lang string, source string, rid int, fp int"


def frame(spark, tmp_path, rows):
    """A table read from files, with columns whose names operators use inside."""
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(i, t, "en", s, 0, 0) for i, t, s in rows], SCHEMA).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


ROWS = [(1, "One two  three four five six", "a"), (2, "One two three four five six", "a"), (3, None, None), (4, "", "b"), (5, " \t\n", "b"), (None, "lone words here", "a"), (2, "One two three four five six", "a"), (6, "seven " * 3000, "c")]


@pytest.fixture
def docs(spark, tmp_path):
    return frame(spark, tmp_path, ROWS)


def test_exact_dedup(docs):
    got = exact_dedup.decisions(docs).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.text_sha256): r for r in got}
    norm = lambda t: hashlib.sha256(re.sub(r"[ \t-\r]", "", t or "").encode()).hexdigest()
    assert {r.text_sha256 for r in got} == {norm(t) for _, t, _ in ROWS}
    assert by[2, norm(ROWS[1][1])].keep_id == 1 and by[2, norm(ROWS[1][1])].group_size == 3
    assert by[5, norm("")].keep_id == 5 and by[3, norm("")].group_size == 3
    assert sum(r.kept for r in got) == 4 == exact_dedup.exact_dedup(docs).count()


def test_filters_merge_losslessly():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 50, 1000).astype(np.uint64) * np.uint64(0x123456789ABCDEF)
    parts = [exact_dedup.CountingQuotientFilter.of(x) for x in np.array_split(prints, 7)]
    whole = exact_dedup.CountingQuotientFilter.merged(parts)
    assert dict(zip(whole.prints().tolist(), whole.counts.tolist(), strict=True)) == dict(zip(*(x.tolist() for x in np.unique(prints, return_counts=True)), strict=True))


def test_mix(docs):
    got = mixing.copies(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.copies <= 2 for r in got)
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in mixing.copies(docs).collect()}
    assert mixing.mix(docs).columns == docs.columns


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    tok, own, rng = Tokenizer.from_file(path), bpe.PairIndexBPE(path), random.Random(1)
    texts = ["", "<|endoftext|>a <|endoftext|>", "a" * 500, *("".join(rng.choice(["a", "b ", " ", "\n", "'re", "é", "中", "12", "!", "\x1c", "\x85"]) for _ in range(40)) for _ in range(300))]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and own.decode(ids) == tok.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs, path).count() == len(ROWS) and bpe.encode(docs.limit(0), path).count() == 0


def test_simhash_loses_no_link():
    rng = np.random.default_rng(2)
    own = [rng.integers(0, 1 << 63, 100, dtype=np.uint64)]
    for _ in range(5):
        x = rng.choice(np.concatenate(own), 100)
        for _ in range(4):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
        own.append(x)
    p = np.unique(np.concatenate(own))
    buckets, places = simhash.bucket_keys(p[:, None])
    root = {int(x): int(x) for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(*(x.tolist() for x in simhash.bucket_links(buckets, p[places][:, None], 4)), strict=True):
        assert find(a) == find(b) or root.update({max(find(a), find(b)): min(find(a), find(b))}) is None
    i, j = np.nonzero(np.bitwise_count(p[:, None] ^ p[None, :]) <= 4)
    assert all(find(int(p[a])) == find(int(p[b])) for a, b in zip(i, j, strict=True))


def test_simhash_components(docs):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (None, None)} == got
    assert simhash.keep_one(docs).count() == 4


def test_line_dedup(spark, tmp_path):
    p, q = "this passage repeats over documents again", "a second line that also comes back"
    docs = frame(spark, tmp_path, [(1, f"{p}\n{q}\nfirst own line of some words", "a"), (2, f"another line of its own here\n{p}\n{q}", "a"), (3, None, "b"), (4, "short", "a"), (5, "short", "a")])
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: (f"{p}\n{q}\nfirst own line of some words", 0), 2: ("another line of its own here", 2), 3: ("", 0), 4: ("short", 0), 5: ("short", 0)}


def test_topk(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.2, (150, 8)).astype("float32")
    x[100:110] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1020, [float("nan")] * 8)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    f = np.floor(64 * x.astype(float)).astype(int)
    for q in range(0, 150, 20):
        best = sorted((-int(f[q] @ f[k]), k) for k in range(150) if k != q)[:20]
        assert sorted(got[q]) == [(n, k, -s) for n, (s, k) in enumerate(best, 1)]


@pytest.mark.parametrize("large", [1e30, 1e9])
def test_topk_refuses_scores_beyond_64_bits(spark, large):
    rows = [(0, [large, 1.0]), (1, [2.0, 1.0]), (20, [large, large])]
    with pytest.raises(Exception, match="too large|64 bits"):
        topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(7)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((quality.Trees.fit(x[:400], y[:400]).predict(x[400:]) > 0.5) == y[400:]).mean() > 0.9
    assert quality.Trees.fit(x[:0], y[:0]).predict(x[:2]).tolist() == [0.5, 0.5]


def test_near_copies_by_similarity(spark, tmp_path):
    """Groups are the components of pairs at 0.8 or more; documents below it stay."""
    rng = random.Random(8)
    rows, k = [], 0
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 40, 200]))]
        for share in (0, 0.01, 0.05, 0.1):
            own = [f"x{rng.randrange(5000)}" if rng.random() < share else w for w in base]
            rows.append((k := k + 1, " ".join(own), "a"))
    rows += [(900, None, None), (901, "", "b"), (902, "a b c " * 50, "c"), (903, "a b c " * 60, "c")]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a in sets for b in sets if a < b and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    for a, b in pairs:
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, tmp_path, rows), 5, simhash.WIDE_DISTANCE, (simhash.SEED, simhash.MORE_SEED), 0.8).collect()}
    assert all(find(i) == find(c) for i, c in got.items())
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs) and len(pairs) > 60


def test_nearest_forest_spans_what_pairs_join():
    rng = np.random.default_rng(9)
    own = np.unique(np.concatenate([(x := rng.integers(0, 1 << 63, 1, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(4)]))[:, None]
    u, v = simhash.nearest_links(own, 2)
    assert len(u) == len(own) - 4 and (simhash.differing(u, v) <= 2).all()
    a, b = simhash.nearest_forest(simhash.nodes_of(u), simhash.nodes_of(v), simhash.differing(u, v))
    assert len(a) == len(u)


@pytest.mark.parametrize("group", [16 << 20, 200_000])
def test_copies_around_one_base_all_join_it(spark, tmp_path, monkeypatch, group):
    """Copies that are nearer to each other in bits than to the base, but alike to the base only, are all dropped."""
    monkeypatch.setattr(simhash, "GROUP", group, raising=False)
    rng = random.Random(10)
    base = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(base), "a")]
    for k in range(1000):
        own = list(base)
        for at in rng.sample(range(0, 200, 5), 4):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((k + 2, " ".join(own), "a"))
    cut = lambda t: {tuple(t.split()[k : k + 5]) for k in range(196)}
    sets = {i: cut(t) for i, t, _ in rows}
    due = {i for i in sets if i > 1 and len(sets[i] & sets[1]) >= 0.8 * len(sets[i] | sets[1])}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, tmp_path, rows), 5, simhash.WIDE_DISTANCE, (simhash.SEED, simhash.MORE_SEED), 0.8).collect()}
    joined = sum(got[i] == 1 for i in due)
    assert len(due) == 1000 and joined >= 0.99 * len(due)


def test_pairs_of_128_bits_meet_in_a_bucket(spark, monkeypatch):
    """Of pairs that differ in 14.5 % of the bits, as at a similarity of 0.8, 97 % meet; links join all that meet, hot or not."""
    rng = np.random.default_rng(11)
    a = rng.integers(0, 1 << 63, (2000, 2), dtype=np.uint64)
    b = a ^ np.packbits(rng.random((2000, 128)) < 0.145, axis=1).view("<u8")
    near = simhash.differing(a, b) <= simhash.WIDE_DISTANCE
    a, b = a[near], b[near]
    keys = []
    for x in (a, b):
        buckets, places = simhash.bucket_keys(x)
        keys.append(set(zip(buckets.tolist(), places.tolist(), strict=True)))
    met = {i for _, i in keys[0] & keys[1]}
    assert len(met) >= 0.97 * len(a) > 1700
    prints = spark.createDataFrame([(x,) for x in np.concatenate([a, b]).view(np.int64).tolist()], "fp array<long>")
    want = {tuple(sorted(x)) for x in zip(*(simhash.nodes_of(x[sorted(met)]).view(np.int64).tolist() for x in (a, b)), strict=True)}
    got = {tuple(sorted((r.u, r.v))) for r in simhash.links(prints, simhash.WIDE_DISTANCE, 2, True).collect()}
    assert got == want


def test_hot_buckets_of_128_bits_join_all(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = np.random.default_rng(12)
    own = rng.integers(0, 1 << 63, (1, 2), dtype=np.uint64) ^ np.packbits(rng.random((60, 128)) < 0.02, axis=1).view("<u8")
    prints = spark.createDataFrame([(x,) for x in own.view(np.int64).tolist()], "fp array<long>").distinct()
    got = simhash.components(simhash.links(prints, simhash.WIDE_DISTANCE, 2, True)).collect()
    assert len(got) == prints.count() > 40 and len({r.root for r in got}) == 1


def test_line_dedup_leaves_no_shared_line(spark, tmp_path):
    """Lines that repeat in the holder or in the later document, or come in another order, go like any other."""
    p, q, r = "this passage repeats over documents again", "a second line that also comes back", "the third line of five words"
    rng = random.Random(13)
    rows = [(1, f"{p}\n{q}\n{p}\n{r}", "a"), (2, f"own line of the second document\n{p}", "a"), (3, f"{r}\n{q}\n{r}\nshort", "a")]
    rows += [(k, "\n".join(rng.choice([p, q, r, f"line number {n} of several such"]) for n in rng.choices(range(12), k=8)), "a") for k in range(4, 40)]
    seen, want = set(), {}
    for i, text, _ in rows:
        want[i] = "\n".join(x for x in text.split("\n") if x not in seen)
        seen.update(x for x in text.split("\n") if len(x.split()) >= 5)
    assert {x.doc_id: x.text for x in line_dedup.line_dedup(frame(spark, tmp_path, rows)).collect()} == want
