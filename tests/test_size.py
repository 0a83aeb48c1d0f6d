"""Steps whose cost must follow the input: what they no longer build, and that results stay."""

import math

import duckdb
from pyspark.sql import functions as F

from textloom import queries as Q
from textloom.operators import cleaning as C
from textloom.operators import packing as P
from textloom.operators import surprisal as S
from textloom.operators import tokens as K
from textloom.sources import tables as B

HERE = "/root/testdata/sf0.001"


def test_attended_places_equal_the_mask(spark, monkeypatch):
    cases = [[0, 0, 0, 1, 1, 2, -1, -1], [-1, -1], [], [3], [0, 1, 0, 1, 1, -1, 0]]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, s array<int>")
    mask = F.expr("aggregate(m, 0L, (t, r) -> t + size(filter(r, x -> x)))")
    got = df.withColumn("m", P.attention_mask(F.col("s"))).select(mask.alias("want"), P.attended(F.col("s")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    monkeypatch.setattr(P, "attention_mask", lambda *_: 1 / 0)
    assert Q.packed_masks(spark, HERE).where("attended > 0").count()


def test_numbers_of_five_digits_are_written_as_the_sql_writes_them(spark, monkeypatch):
    bins = [7, 1234, 9999, 12340, 12341, 123456]
    own = spark.createDataFrame([(f"train-web-{b:04d}", b, [b % 9, 2]) for b in bins], "shard_id string, bin long, tokens array<int>")
    own = own.withColumns({"n_tokens": F.lit(2).cast("long"), "hash": P.tokens_hash(F.col("tokens"))})
    monkeypatch.setattr(Q, "_shards", lambda *_: own)
    want = duckdb.sql(f"SELECT 'train-web-' || lpad(CAST(bin AS VARCHAR), 4, '0'), bin % 2 = 0 FROM (SELECT unnest({bins}) AS bin)").fetchall()
    assert sorted(map(tuple, Q.shard_verify(spark, HERE).collect())) == sorted(want)


def test_workers_get_small_batches(spark, tmp_path):
    """A session's larger setting is lowered by each step that sends whole texts or shards to workers, a smaller one stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    seen = str(tmp_path / "seen")
    for before, after in (("1g", str(B.BATCH)), ("1m", "1m")):
        spark.conf.set(key, before)
        B.slim_batches(spark)
        assert spark.conf.get(key) == after
    spark.conf.set(key, "1g")
    docs = spark.createDataFrame([(f"s-{k}", k, "train", "web", "T0", [k] * 9) for k in range(4)], "id string, pos long, split string, lane string, provenance_tier string, tokens array<int>")
    for step in (lambda: P.write_shards(P.shards(docs, 1, 2, cap=30), seen), lambda: P.read_shards(spark, seen), lambda: K.encode(docs.select("id", F.lit("a b").alias("text")), {}, []), lambda: Q.R.corpus(spark, HERE)):
        spark.conf.set(key, "1g")
        step()
        assert spark.conf.get(key) == str(B.BATCH)
    spark.conf.unset(key)


def test_what_an_encoder_keeps_is_bounded_and_changes_nothing(spark, monkeypatch):
    vocab, merges = K.learn_merges({"abab": 5, " ab": 3}, 262)
    texts = ["abab ab abc " * 5, "x" * 200 + " abab", "", "y ab y ab"]
    docs = spark.createDataFrame([(f"s-{k}", t) for k, t in enumerate(texts)], "id string, text string")
    want = {r.id: r.tokens for r in K.encode(docs, vocab, merges).collect()}
    monkeypatch.setattr(K, "KNOWN", 2)
    monkeypatch.setattr(K, "KNOWN_CHARS", 3)
    assert {r.id: r.tokens for r in K.encode(docs, vocab, merges).collect()} == want
    assert {r.id: r.text for r in K.decode(K.encode(docs, vocab, merges), vocab).collect()} == {f"s-{k}": t for k, t in enumerate(texts)}


def test_runs_are_counted_as_hashes(spark, monkeypatch):
    monkeypatch.setattr(C, "TEXT_A_TASK", 1000)
    docs = Q.R.corpus(spark, HERE)
    got = C.gram_frequencies(docs)
    want = C.document_grams(docs).groupBy("gram").count().groupBy("count").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = Q.ngram_df(spark, HERE)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" in plan and "hashpartitioning(gram#" not in plan


def test_bigrams_that_nobody_asks_for_are_not_kept(spark, monkeypatch):
    train = spark.createDataFrame([(1, "a b a b c"), (2, "x y z"), (3, " b  c "), (4, ""), (5, "a")], "id int, text string")
    pairs = spark.createDataFrame([("p", "a b q"), ("q", "b c b"), ("r", "new words")], "id string, text string")
    kept = []
    monkeypatch.setattr(S, "written", lambda df: kept.append(df.collect()) or df)
    few = sorted(map(tuple, S.pair_surprisal(train, pairs).collect()))
    assert set(map(tuple, kept[0])) == {("a", "b", 2), ("b", "c", 2), ("b", None, 1)}
    monkeypatch.setattr(S, "ASKED", 0)
    assert sorted(map(tuple, S.pair_surprisal(train, pairs).collect())) == few
    # v is 5: b, a, c, y, z come second.
    want = -math.log(3 / 7) - math.log(1 / 8)
    assert few[0][:2] == ("p", 2) and abs(few[0][2] - want) < 1e-3


def test_pairs_are_the_same_however_many_tasks_they_meet_in(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*words[:40 + k % 20], f"z{k % 3}"]) for k in range(12)]
    docs = spark.createDataFrame([(f"s-{k}", k, t) for k, t in enumerate(texts)], "id string, pos long, text string")
    sigs = C.signatures(docs).dropDuplicates(["sig"]).cache()
    held = {r.pos: list(r.sig) for r in sigs.collect()}
    want = {(a, b) for a in held for b in held if a < b and sum(x == y for x, y in zip(held[a], held[b], strict=True)) >= 26}
    monkeypatch.setattr(C, "KEYS_A_TASK", 20)
    monkeypatch.setattr(C, "PAIRS_A_TASK", 5)
    assert {(r.early, r.late) for r in C.similar_pairs(sigs).collect()} == want and want
