"""The run log, the checks over a run's tables, and the roll-up into requirements, each made to fail once."""

import pytest

from textloom.operators import tokens as K
from textloom.plans import evidence as E
from textloom.streaming import batches as B
from textloom.streaming import training as T


def test_the_log_has_no_absolute_paths(spark, tmp_path):
    log = E.RunLog()
    log.info("cleaned", kept=3, share=0.5)
    log.passed("shards_verified", shard="a-0001")
    for path in ("/tmp/x", "C:\\x", "c:/x"):
        with pytest.raises(ValueError):
            log.info("wrote", path=path)
    assert log.lines() == ["[INFO] cleaned kept=3 share=0.5", "[PASS] shards_verified shard=a-0001"]
    log.write(spark, f"{tmp_path}/log")
    assert [r.value for r in spark.read.text(f"{tmp_path}/log").collect()] == log.lines()
    assert E.RunLog().table(spark).count() == 0
    assert [df.count() for df in E.stored(spark, str(tmp_path))] == [0, 0]


def tables(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    checks = t([(c, True) for c in ("tokenizer_verify", "checkpoint_verify", "shards_verify", "firewall_disjoint", "ledger_consistent", "log_complete")], "check string, ok boolean")
    return dict(checks=checks, emitted=t([(x,) for x in E.EVENTS], "event string"), packing=t([(0.9,)], "packing_efficiency double"), mixture=t([("web", True)], "lane string, all_floors_met boolean"), decisions=t([(1,)], "id int"), learning=t([(1,)], "id int"), measured=t([(1,)], "id int"))


def test_each_requirement_fails_once(spark):
    whole = tables(spark)
    failed = lambda **change: {r.requirement for r in E.requirements(**{**whole, **change}).where("result = 'FAIL'").collect()}
    assert failed() == set() and E.markdown(E.requirements(**whole))[2] == "**Overall: all requirements pass**"
    none = {name: df.limit(0) for name, df in whole.items()}
    assert failed(**none) == set(E.REQUIREMENTS) and "| Replay | FAIL |" in E.markdown(E.requirements(**none))
    want = {"packing": "Packing correctness", "mixture": "Mixture compliance", "decisions": "OPUS audit trail", "learning": "Learning trace", "measured": "Throughput"}
    assert all(failed(**{name: none[name]}) == {x} for name, x in want.items())
    assert failed(emitted=whole["emitted"].where("event <> 'replay_hash_matched'")) == {"Replay"}
    assert failed(checks=whole["checks"].where("check <> 'checkpoint_verify'")) == {"Crash recovery"}


def test_checks_of_tables_fail_under_tampering(spark, tmp_path):
    rows = spark.createDataFrame([(k, "a", [k, k + 1], [1, 0], 1) for k in range(5)], "seq long, lane string, tokens array<int>, loss_mask array<int>, n_loss long")
    stream, path = B.BatchStream(rows, batch_size=2), str(tmp_path)
    B.consume(stream, f"{path}/ledger", 3)
    T.train(stream, path, 3, 6)
    consumption, learning = E.stored(spark, path)
    vocab, merges = K.learn_merges({"ab": 3, "b": 1}, 262)
    from textloom.operators import packing as P

    docs = spark.createDataFrame([(f"d-{k}", k, "web", "T0", "eval" if k == 3 else "train", [5, 6, 7]) for k in range(4)], "id string, pos long, lane string, provenance_tier string, split string, tokens array<int>")
    P.write_shards(P.shards(docs, 1, 2, 8), f"{path}/shards")
    shards, index = P.read_shards(spark, f"{path}/shards"), spark.read.parquet(f"{path}/shards/index")
    args = dict(shards=shards, index=index, admitted=index.where("split = 'train'"), tokenizer=(vocab, merges, K.tokenizer_hash(vocab, merges)), consumption=consumption, learning=learning, checkpoints=f"{path}/checkpoints", emitted=spark.createDataFrame([(x,) for x in E.EVENTS], "event string"))
    failed = lambda **change: {r.check for r in E.audit_checks(**{**args, **change}).where("NOT ok").collect()}
    assert failed() == set()
    assert failed(admitted=index, tokenizer=(vocab, merges, "x"), consumption=consumption.limit(1), emitted=args["emitted"].limit(2), checkpoints=f"{path}/none") == {"firewall_disjoint", "tokenizer_verify", "ledger_consistent", "log_complete", "checkpoint_verify"}
    assert failed(learning=learning.limit(0)) == {"ledger_consistent"}
