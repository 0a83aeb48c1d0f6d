"""Queries and stages as registered: folds, settings, row identity, clashing names, the pipeline stage by stage."""

import hashlib
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from textloom.llm import bpe, common, exact_dedup, line_dedup, mixing, quality, simhash

SF = "/root/testdata/sf0.001"
NAMES = "doc_id long, text string, source string, _rid int, rid int, file_ int, block_ int, row_ int, value_ int, _copies int, _gone int, lang string"


def crowded(spark, rows):
    """A table that isn't a scan, whose columns have the names that operators like."""
    return spark.createDataFrame([(i, t, s, *[7] * 8, "en") for i, t, s in rows], NAMES).repartition(3)


P = "this passage of several words repeats over documents"
ROWS = [(k, f"{P}\nown line number {k} of this text with words", "ab"[k % 2]) for k in range(8)] + [(8, None, None), (9, "", "a"), (None, "lone words here", "a"), (3, f"{P}\nown line number 3 of this text with words", "b"), (10, "word " * 30_000, "c")]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_marks_meet_their_rows(spark, most):
    docs = common.stable(crowded(spark, ROWS * 40))
    at = docs.select(common.rid(docs).alias("rid"), "doc_id").withColumn("value", (F.col("rid.row") % (most + 1)))
    out, key, value = common.marked(docs, common.marks(at.where("value > 0"), most), most)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == len(ROWS) * 40
    assert out.where(F.col(value) != F.col(key)["row"] % (most + 1)).count() == 0


def test_row_filters_keep_columns_and_settings(spark):
    docs, before = crowded(spark, ROWS), {k: spark.conf.get(k, None) for k in ("spark.sql.files.minPartitionNum", "spark.checkpoint.dir", "spark.sql.execution.arrow.maxBytesPerBatch")}
    kept = exact_dedup.exact_dedup(docs)
    norm = {re.sub(r"[ \t-\r]", "", t or "") for _, t, _ in ROWS}
    assert kept.columns == docs.columns and kept.where("_rid <> 7 OR _gone <> 7").count() == 0 and kept.count() == len(norm)
    near = simhash.keep_one(docs)
    assert near.columns == docs.columns and near.count() == len(norm)
    counts = mixing.copies(docs)
    taken = Counter()
    for r in counts.collect():
        taken[r.doc_id] += r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == +taken
    lines = line_dedup.line_dedup(docs)
    assert lines.columns == [c for c in docs.columns if c != "text"] + ["text", "n_lines", "n_removed"]
    assert sum(P in (r.text or "") for r in lines.collect()) == 1
    assert {k: spark.conf.get(k, None) for k in before} == before
    for f in (exact_dedup.exact_dedup, simhash.keep_one, mixing.mix, line_dedup.line_dedup):
        assert f(docs.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(bare)
    table = common.written(spark.range(3))
    common.discard(table)
    with pytest.raises(Exception, match="(?i)does not exist|not_exist|FileNotFound"):
        spark.read.parquet(table._textloom_path).count()


def test_quality_learns_from_its_folds_only(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(common.remainder(quality.FOLDS) == quality.TEST, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a, b = quality.learn(docs, labels), quality.learn(docs, flipped)
    assert (a.feature == b.feature).all() and (a.value == b.value).all()
    got = {r.doc_id: r for r in quality.op3_quality(spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out and r.quality is not None]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([x > y for x in good for y in bad]) >= 0.9
    kept = quality.keep_good(crowded(spark, ROWS), labels)
    scores = {(r.doc_id, round(r.score, 9)) for r in quality.scored(crowded(spark, ROWS), quality.learn(crowded(spark, ROWS), labels)).collect()}
    assert kept.columns == crowded(spark, ROWS).columns and len(scores) >= len(ROWS) - 2


def plain_print(text):
    w = text.encode().lower().split()
    own = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def test_simhash_query_equals_brute_force(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = [plain_print(t) for _, t in docs]
    root = roots(len(docs), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    want = {i: (f"{p:016x}", docs[r][0]) for (i, _), p, r in zip(docs, prints, root, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, SF).collect()} == want


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, functions = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("quality", "exact_dedup", "near_dedup", "mix", "bpe")
    good = common.written(functions[0](spark, docs, SF))
    trees = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    chance = {i: trees.predict(np.array([quality.statistics(t or "")]))[0] for i, t in texts.items()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, c in chance.items() if c >= 0.5}
    first = {}
    for r in sorted(good.collect(), key=lambda r: (-len(r.text or ""), r.doc_id)):
        first.setdefault(re.sub(r"[ \t-\r]", "", r.text or ""), r.doc_id)
    exact = common.written(functions[1](spark, good, SF))
    assert {r.doc_id for r in exact.collect()} == set(first.values())
    rows = sorted((r.doc_id, (r.text or "").lower().split()) for r in exact.collect())
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for _, w in rows]
    root = roots(len(rows), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    near = common.written(functions[2](spark, exact, SF))
    stay, due = {r.doc_id for r in near.collect()}, {rows[x][0] for x in set(root)}
    # Candidates come from fingerprints, which miss a few links (README); nothing else goes.
    assert due <= stay and len(stay - due) <= max(1, 0.1 * (len(rows) - len(due)))
    mix = common.written(functions[3](spark, near, SF))
    counts = Counter(r.doc_id for r in mix.collect())
    assert mix.columns == docs.columns and max(counts.values()) <= 2 and set(counts) <= {r.doc_id for r in near.collect()}
    assert counts == +Counter({r.doc_id: r.copies for r in mixing.copies(near).collect()})
    tok = Tokenizer.from_file(bpe.vocabulary_path())
    for r in functions[4](spark, mix, SF).collect():
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
