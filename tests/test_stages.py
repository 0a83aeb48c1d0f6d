"""Cleaning, sources, splits, shards, streams and the whole chain, against plain Python and under tampering."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import queries as Q
from textloom.functions import text as X
from textloom.operators import cleaning as C
from textloom.operators import packing as P
from textloom.operators import planning as G
from textloom.operators import surprisal as S
from textloom.plans import clean as plan
from textloom.plans import evidence as E
from textloom.plans import run as chain
from textloom.sources import corpus as R
from textloom.streaming import batches as B

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(rf"[\w{X.MARKS}]+", t)


def frame(spark, texts, prefix="s"):
    return spark.createDataFrame([(f"{prefix}-{k:07d}", k, t) for k, t in enumerate(texts)], "id string, pos long, text string").repartition(3)


def test_quality_equals_a_loop(spark):
    rng = random.Random(1)
    texts = ["", "short", "one two three four five", "a b", "!!! ??? --- *** ((( )))", "dup " * 30, "naïve नमस्ते 中文 résumé deux trois"]
    texts += ["".join(rng.choice(["ab ", "cd\n", "!", "é", " ", "x1 "]) for _ in range(60)) for _ in range(60)]
    want = {}
    for k, t in enumerate(texts):
        w, s = words(t), re.sub(r"\s", "", t)
        symbols = sum(not re.match(rf"[\w{X.MARKS}]", c) for c in s) / len(s) if s else 0.0
        top = max(Counter(x.lower() for x in w).values(), default=0) / len(w) if w else 0.0
        want[f"s-{k:07d}"] = "too short" if len(t.strip()) < 20 else "too few words" if len(w) < 5 else "symbol-heavy" if symbols > 0.5 else "repetitive" if top > 0.6 else None
    assert {r.id: r.reason for r in C.quality_verdicts(frame(spark, texts)).collect()} == want


def test_phones_equal_python(spark):
    rng = random.Random(2)
    pattern = re.compile(r"(?<!\w)(?:\+\d[\d \t().\-]{5,}\d|\(\d{2,4}\)[ \t]?[\d \t().\-]{4,}\d)(?!\w)")
    texts = ["".join(rng.choice(["1", "23", "+", "(", ")", " ", "-", "a", "(415) "]) for _ in range(14)) for _ in range(400)]
    want = {f"s-{k:07d}": pattern.sub(lambda m: "[PHONE]" if sum(c.isdigit() for c in m.group()) >= 7 else m.group(), t) for k, t in enumerate(texts)}
    assert {r.id: r.t for r in frame(spark, texts).select("id", X.scrub_phones(F.col("text")).alias("t")).collect()} == want


@pytest.mark.parametrize("local", [3, 500_000])
def test_first_kept_equals_a_loop(spark, local):
    """Random graphs and a chain, by rounds and by one task."""
    rng = random.Random(3)
    edges = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(70)) if a < b} | {(k, k + 1) for k in range(100, 112)}
    kept = {}
    for n in sorted({x for e in edges for x in e}):
        kept[n] = not any(kept[a] for a, b in edges if b == n)
    got = C.first_kept(spark.createDataFrame(sorted(edges), "early long, late long"), local).collect()
    assert len(got) == len(kept) and {r.pos: r.kept for r in got} == kept


def test_near_duplicates_equal_a_loop(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(70):
        own = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 30, 60]))]
        for _ in range(5):  # a chain: each differs a little from the one before
            texts.append(" ".join(own))
            own = list(own)
            own[rng.randrange(len(own))] = f"x{rng.randrange(400)}"
    rng.shuffle(texts)
    texts += ["", " ", texts[0]]
    sigs = []
    for t in texts:
        w = [x.lower() for x in words(t)]
        grams = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
        h = [zlib.crc32(g.encode()) for g in grams]
        sigs.append([min([(a * x + b) % C.PRIME for x in h], default=C.PRIME) for a, b in C.COEFFICIENTS])
    kept, want = [], {}
    for k, s in enumerate(sigs):
        best = max(((sum(x == y for x, y in zip(s, sigs[j], strict=True)) / 32, -j) for j in kept if any(s[i : i + 2] == sigs[j][i : i + 2] for i in range(0, 32, 2))), default=(0, 0))
        if best[0] >= 0.8:
            want[k] = (-best[1], round(best[0], 4))
        else:
            kept.append(k)
    got = {int(r.id[2:]): (int(r.near[2:]), r.est_jaccard) for r in C.near_duplicates(frame(spark, texts)).collect()}
    assert got == want and len(want) > 50


def grams(t):
    w = [x.lower() for x in words(t)]
    return {" ".join(w[i : i + 13]) for i in range(len(w) - 12)}


def test_contamination_with_pairs_equals_a_loop(spark):
    rng = random.Random(5)
    make = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    held, common = [make(40) for _ in range(12)], make(14)
    held = [f"{h} {common}" for h in held]
    pairs = [(f"pair-{k:04d}", make(10), make(10), make(10)) for k in range(1, 4)]
    docs = [make(60) for _ in range(20)] + [f"{make(9)} {held[3]}", f"{held[1]} {held[2]}", f"a b {pairs[0][1]} {pairs[0][2]} c", common, ""]
    index = {}
    for k, t in enumerate(held):
        for g in grams(t):
            index.setdefault(g, set()).add(f"b-{k:07d}")
    for i, a, b, c in pairs:
        for g in grams(f"{a} {b}") | grams(f"{a} {c}"):
            index.setdefault(g, set()).add(i)
    index = {g: s for g, s in index.items() if len(s) <= max(1, int(0.3 * 15))}
    want = {}
    for k, t in enumerate(docs):
        if hit := grams(t) & index.keys():
            want[f"s-{k:07d}"] = (len(hit), sorted(set().union(*(index[g] for g in hit)))[:5], min(hit))
    df = spark.createDataFrame([(i, a, b, c) for i, a, b, c in pairs], "id string, prefix string, y_plus string, y_minus string")
    got = {r.id: (r.overlap, r.matched_sources, r.sample_ngram) for r in C.contaminated(frame(spark, docs), frame(spark, held, "b"), pairs=df).collect()}
    assert got == want and len(want) == 3


def test_cleaning_report_adds_up(spark):
    docs = R.corpus(spark, SF)
    left, drops, masked = plan.clean(docs, R.benchmark(spark, SF), pairs=Q._pairs(spark, SF), symmetric=True)
    rows = plan.report(docs, drops, masked).orderBy("ord").collect()
    assert [r.stage for r in rows] == list(plan.STAGES) and rows[0].input == docs.count()
    assert all(a.kept == b.input and a.input - a.dropped == a.kept for a, b in zip(rows, rows[1:], strict=False)) and rows[-1].kept == left.count()
    assert sum(r.redactions for r in rows) == sum(r.redactions for r in masked.collect()) and drops.where("detail IS NULL OR detail = ''").count() == 0


def test_pairs_are_minted_and_checked(spark):
    spec = spark.createDataFrame([(5, "t", "p", "a", "b"), (2, "t", "p", "same", " same ")], "pos long, topic string, prefix string, y_plus string, y_minus string")
    pairs = G.minted_pairs(spec)
    assert {r.id: r.v for r in pairs.select("id", G.pair_violation().alias("v")).collect()} == {"pair-0001": "no contrast", "pair-0002": None}
    assert pairs.withColumn("chauvinism", F.lit("some")).where(G.pair_violation() == "chauvinism").count() == 2


def upstream(spark):
    rows = spark.createDataFrame([(10**7 + 3 * k, {"body": " " if k % 4 == 0 else f"text number {k} of this table"}) for k in range(40)], "row long, item map<string,string>")
    return lambda source_id: (rows, "rev-1", "row")


def test_fetch_all_validates_caches_and_logs(spark, tmp_path):
    path = str(tmp_path)
    sound = spark.createDataFrame([(f"s{k}", lane, "T1", "set", "item.body", "cc0", 60, False) for k, lane in enumerate(R.LANES)], R.SOURCE)
    with pytest.raises(ValueError, match="unsound"):
        R.fetch_all(sound.withColumn("gated", F.col("lane") == "web"), upstream(spark), path, pool=300)
    with pytest.raises(ValueError, match="pinned"):
        R.fetch(upstream(spark)("")[0], "s", "web", "T0", None, "item.body", 9, "row")
    first = R.fetch_all(sound, upstream(spark), path, pool=300)
    assert first.count() == 5 and R.fetch_all(sound, upstream(spark), path, pool=300).count() == 0
    assert R.fetch_all(sound, upstream(spark), path, force=True, pool=300).count() == 5
    log = R.read_parquet(spark, f"{path}/log", R.LOG)
    assert log.count() == 10 and {r.seq for r in R.last_records(log).collect()} == set(range(6, 11))
    docs = [r for r in spark.read.parquet(f"{path}/documents").where("source_id = 's0'").orderBy("pos").collect()]
    used, want = 0, []
    for k in range(40):
        if k % 4 and used < 60:
            want.append((f"s0-{k:07d}", f"text number {k} of this table"))
            used += max(1, len(want[-1][1]) // 4)
    assert [(r.id, r.text) for r in docs] == want and docs[0].source == "s0@rev-1"
    assert {r.lane: r.target_tokens for r in R.lane_targets(sound).collect()} == dict.fromkeys(R.LANES, 60)


def test_json_lines_and_file_hashes(spark, tmp_path):
    rows = spark.createDataFrame([("a", "web", "T0", "train", "s", "x\nन"), ("b", "math", "T1", "eval", "s", "")], R.DOCUMENT)
    R.write_jsonl(rows, str(tmp_path / "j"))
    assert sorted(map(tuple, R.read_jsonl(spark, str(tmp_path / "j")).collect())) == sorted(map(tuple, rows.collect()))
    assert R.read_jsonl(spark, str(tmp_path / "none"), missing_ok=True).count() == 0
    lines = [x for p in (tmp_path / "j").glob("part*") for x in p.read_text().splitlines()]
    assert all(list(json.loads(x)) == sorted(json.loads(x)) for x in lines)
    for r in R.files_sha256(spark, str(tmp_path / "j")).where("path LIKE '%part-%'").collect():
        assert r.sha256 == hashlib.sha256(open(r.path.removeprefix("file:"), "rb").read()).hexdigest()


def test_carving_is_idempotent(spark, tmp_path):
    docs, path = R.corpus(spark, SF), str(tmp_path / "eval")
    a, b = G.carve_eval(docs, path, 0.1).first(), G.carve_eval(docs, path, 0.1).first()
    assert not a.cached and b.cached and a.fingerprint == b.fingerprint
    ids = sorted(r.id for r in G.load_eval_ids(spark, path).collect())
    assert a.fingerprint == hashlib.sha256("\n".join(ids).encode()).hexdigest() and len(ids) == a.selected_count > 0
    held = spark.read.parquet(f"{path}/documents")
    assert sorted(r.id for r in held.collect()) == ids and held.where("split <> 'eval' OR provenance_tier NOT IN ('T0', 'T1')").count() == 0
    assert not G.carve_eval(docs, path, 0.1, "another seed").first().cached


def test_shards_as_bytes_and_tampering(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{k}", k, "train" if k % 3 else "eval", "web", "T0", [k, 60000, k + 1]) for k in range(12)], "id string, pos long, split string, lane string, provenance_tier string, tokens array<int>")
    P.write_shards(P.shards(docs, 1, 2, cap=12), str(tmp_path))
    own, index = P.read_shards(spark, str(tmp_path)), spark.read.parquet(str(tmp_path / "index"))
    assert {r.id: r.tokens for r in P.iter_docs(own, "train").collect()} == {f"d{k}": [k, 60000, k + 1] for k in range(12) if k % 3}
    assert all(r.ok for r in P.verify_shards(own, index).collect())
    bad = own.withColumn("tokens", F.when(F.col("bin") == 1, F.transform("tokens", lambda x, i: F.when(i == 3, x + 1).otherwise(x))).otherwise(F.col("tokens")))
    assert {r.shard_id for r in P.verify_shards(bad, index).collect() if not r.ok} == {r.shard_id for r in index.where("bin = 1").collect()}
    blocked = G.shards_blocked(index, index.where("split = 'train'")).first()
    assert blocked.ok and blocked.blocked == blocked.eval_shards == 2 and not G.shards_blocked(index, index).first().ok


def sequences(spark, n=40):
    return spark.createDataFrame([(k, "abc"[k % 3], [k, k + 1], 1) for k in range(n)], "seq long, lane string, tokens array<int>, n_loss long").repartition(3)


def test_batches_equal_numpy(spark):
    stream = B.BatchStream(sequences(spark), batch_size=4, weights={"a": 1, "b": 3})
    lanes = {x: [k for k in range(40) if "abc"[k % 3] == x] for x in "abc"}
    for r in stream.batches(0, 5).collect():
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{B.MASTER_SEED}:{r.batch_index}".encode()).digest()[:8], "big"))
        want = []
        for _ in range(4):
            own = lanes["abc"[int(rng.choice(3, p=[0.25, 0.75, 0.0]))]]
            want.append(own[int(rng.integers(len(own)))])
        tokens = [t for k in want for t in (k, k + 1)]
        assert r.seq_indices == want and r.content_hash == hashlib.sha256(np.array(tokens, "<u2").tobytes()).hexdigest()
    assert stream.tokens_of(2, 3).count() == 4


def test_ledger_never_falls_back_and_gaps_show(spark, tmp_path):
    stream, path = B.BatchStream(sequences(spark)), str(tmp_path / "ledger")
    assert [B.consume(stream, path, t).count() for t in (3, 2, 7, 7)] == [3, 0, 4, 0]
    ledger = spark.read.parquet(path)
    assert sorted(r.batch_index for r in ledger.collect()) == list(range(7)) and B.offset(ledger) == 7
    learnt = stream.batches(0, 9).select("batch_id")
    assert S.unmatched(learnt, ledger, "batch_id").count() == 2
    assert [r.ok for r in S.audit({"a": S.unmatched(learnt, ledger, "batch_id"), "b": S.unmatched(ledger, ledger, "batch_id")}).collect()] == [False, True]


def test_a_restarted_stream_neither_skips_nor_repeats(spark, tmp_path):
    B.register(spark)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def go(end):
        rows = spark.readStream.format("batch_slots").option("lanes", "a:5:0.5,b:7:0.5").option("size", 3).option("rate", 4).option("end", end).load()
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds").start()
        until = time.time() + 60
        while time.time() < until and (not q.lastProgress or f'"batch": {end}' not in str(q.lastProgress.sources[0].endOffset).replace("'", '"').replace('":', '": ').replace("  ", " ")):
            time.sleep(0.2)
        q.stop()

    go(6)
    go(14)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    lanes = [("a", 5, 0.5), ("b", 7, 0.5)]
    assert got == sorted((i, k, lane, at) for i in range(14) for k, (lane, at) in enumerate(B.draw(B.MASTER_SEED, i, lanes, 3)))


def test_the_whole_chain(spark, tmp_path):
    got = {(r.stage, r.measure): r.value for r in chain.run(R.corpus(spark, SF), R.benchmark(spark, SF), Q._pairs(spark, SF), str(tmp_path), vocab_size=320, steps=4, cap=8192).collect()}
    assert got["split", "cached"] == 0 and got["tokenizer", "problems"] == 0 and got["verify", "broken"] == 0
    assert got["firewall", "ok"] == 1 and got["firewall", "eval_shards"] == got["firewall", "blocked"] > 0
    assert got["ledger", "batches"] == got["ledger", "distinct"] == got["replay", "matched"] == 4
    assert {m: v for (s, m), v in got.items() if s == "audit"} == {"leaked documents": 0, "events not emitted": 0, "batches not consumed": 0}
    assert got["select", "accept"] > 0 and 0 < got["pack", "token_yield"] <= 1
    assert got["train", "batches"] == 4 and got["train", "loss_positions"] == got["ledger", "loss_positions"] and got["train", "last_loss"] < got["train", "first_loss"]
    assert {m: v for (s, m), v in got.items() if s == "evidence"} == dict.fromkeys(E.REQUIREMENTS, 1)
    row = spark.read.parquet(f"{tmp_path}/performance").first()
    assert row.real_tokens == got["pack", "real_tokens"] and row.steps == 2 and row.loss_tokens_per_sec > 0
    lines = [r.value for r in spark.read.text(f"{tmp_path}/log").collect()]
    assert lines[0].startswith("[INFO] tokenizer trained vocabulary=320") and lines[1:] == [f"[PASS] {x}" for x in E.EVENTS]
