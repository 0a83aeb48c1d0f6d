"""Edit-aware counts against encoding the whole edited text anew."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from textloom.llm import bpe, edit_count


@pytest.fixture(scope="module")
def whole():
    tok = Tokenizer.from_file(bpe.vocabulary_path())
    tok.encode_special_tokens = True
    return lambda text: len(tok.encode(text, add_special_tokens=False).ids)


def made(rng, n):
    return "".join(rng.choice(["a", "b", " ", "  ", "\n", "'", "re", "1", ".", "word", "é", "中"]) for _ in range(n))


@pytest.mark.parametrize("stored", [False, True])
def test_edits_equal_a_recount(whole, stored):
    own, rng = bpe.PairIndexBPE(bpe.vocabulary_path()), random.Random(5)
    for _ in range(120):
        text = made(rng, rng.choice([0, 3, 300, 900]))
        tree = edit_count.CountTree(text, own)
        if stored:
            chars, tokens = tree.sums()
            tree = edit_count.CountTree.restored(text, chars.astype(np.int32).astype(np.int64), tokens, own)
        for _ in range(5):
            a = rng.randint(0, len(text))
            b, new = min(len(text), a + rng.choice([0, 1, 50])), made(rng, rng.choice([0, 1, 20, 700]))
            text = text[:a] + new + text[b:]
            tree.replace(a, b, new)
            assert tree.total() == whole(text) == int(tree.sums()[1].sum()) and int(tree.sums()[0].sum()) == len(text)
        assert tree.text() == text


def test_a_small_edit_encodes_little(whole):
    own, rng = bpe.PairIndexBPE(bpe.vocabulary_path()), random.Random(6)
    text = made(rng, 50_000)
    first = edit_count.CountTree(text, own)
    tree = edit_count.CountTree.restored(text, *first.sums(), own)
    tree.replace(20_000, 20_010, "another word")
    assert tree.total() == whole(text[:20_000] + "another word" + text[20_010:]) and tree.encoded < 8 * edit_count.LEAF


def test_recount_from_stored_leaves(spark, tmp_path, whole):
    rng, path = random.Random(7), bpe.vocabulary_path()
    texts = {k: made(rng, rng.choice([0, 10, 600])) for k in range(30)} | {30: "", 31: None, 32: "long " * 20_000, 33: "<|endoftext|> a"}
    docs = spark.createDataFrame([(k, t, 0, "x") for k, t in texts.items()], "doc_id long, text string, n_edits int, tokens string")
    edit_count.leaf_counts(docs, path).write.parquet(str(tmp_path / "leaves"))
    leaves = spark.read.parquet(str(tmp_path / "leaves"))
    assert {r.doc_id: r.n_tokens for r in leaves.collect()} == {k: whole(t or "") for k, t in texts.items()}
    edits, want = [], {}
    for k, t in texts.items():
        t, cuts = t or "", sorted(rng.sample(range(len(t or "") + 1), min(4, len(t or ""))))
        own = [(a, b, made(rng, rng.choice([0, 3]))) for a, b in zip(cuts[::2], cuts[1::2], strict=False)] or [(0, 0, "new")] * (k == 30)
        edits += [(k, *e) for e in own]
        for a, b, new in reversed(own):
            t = t[:a] + new + t[b:]
        if own:
            want[k] = (len(own), whole(t))
    table = spark.createDataFrame(edits, "doc_id long, start long, end long, new string").repartition(3)
    got = edit_count.recount(docs, leaves, table, path).collect()
    assert {r.doc_id: (r.n_edits, r.n_tokens) for r in got} == want
    assert all(sum(r.tokens) == r.n_tokens for r in got)


def test_query_rows(spark, whole):
    texts = [None, "", "x@y.org\nsame line\nsame line\n\n\nend", "same line\nsame line", "plain", "a@b.com " * 3000, "same line\nsame line"]
    rows = [(k, t, 9, "z") for k, t in enumerate(texts)] + [(6, texts[6], 9, "z"), (None, texts[2], 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid int, edits string").repartition(2)
    got = edit_count.edit_counts(docs, bpe.vocabulary_path())
    assert got.columns == ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded"]
    want = []
    for i, t, *_ in rows:
        t = t or ""
        new, edits = t, edit_count.standard_edits(t)
        for a, b, x in edits:
            new = new[:a] + x + new[b:]
        want.append((i, whole(t), len(edits), whole(new)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in got.collect())
    assert edit_count.edit_counts(docs.limit(0), bpe.vocabulary_path()).count() == 0
