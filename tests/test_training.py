"""Training over batches: losses against a loop, resumption, checkpoints and tampering."""

import math
import random
from collections import Counter

import pytest

from textloom.streaming import batches as B
from textloom.streaming import training as T


@pytest.fixture(scope="module")
def stream(spark):
    rng = random.Random(4)
    rows = [(k, "ab"[k % 2], t := [rng.randrange(4) for _ in range(rng.randrange(1, 7))], [rng.randrange(2) for _ in t], 1) for k in range(12)]
    return B.BatchStream(spark.createDataFrame(rows, "seq long, lane string, tokens array<int>, loss_mask array<int>, n_loss long"), batch_size=3)


def loop(stream, steps, size):
    tokens = {r.seq: (r.tokens, r.loss_mask) for r in stream.sequences.collect()}
    drawn = {r.batch_index: r.seq_indices for r in stream.batches(0, steps).collect()}
    pairs, contexts, losses = Counter(), Counter(), {}
    for i in range(steps):
        seen = [(t[j], t[j + 1]) for s in drawn[i] for t, m in [tokens[s]] for j in range(len(t) - 1) if m[j]]
        if seen:
            losses[i] = len(seen), sum(-math.log((pairs[x] + 1) / (contexts[x[0]] + size)) for x in seen) / len(seen)
        pairs.update(seen)
        contexts.update(a for a, _ in seen)
    return losses, pairs


def test_losses_and_model_equal_a_loop(spark, stream):
    want, pairs = loop(stream, 8, 4)
    losses, model = T.train_range(stream, T.empty(spark), 0, 8, 4)
    got = {r.batch_index: (r.n_loss, r.loss_nats) for r in losses.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
    assert {(r.a, r.b): r.n for r in model.collect()} == dict(pairs)
    row = T.throughput(stream, 8, 4).first()
    assert row.steps == 8 and row.loss_tokens == sum(v[0] for v in want.values()) and row.loss_tokens_per_sec > 0


def test_resumed_training_equals_one_run_and_tampering_shows(spark, stream, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(T.train(stream, one, 6, 4))
    T.train(stream, two, 2, 4)
    assert key(T.train(stream, two, 6, 4, every=3)) == want
    a, b = T.last_checkpoint(spark, f"{one}/checkpoints"), T.last_checkpoint(spark, f"{two}/checkpoints")
    assert a == b and a.step == a.ledger_offset == 6 and T.verify_checkpoint(spark, f"{two}/checkpoints")
    # A smaller target or step changes nothing; another seed is refused.
    assert key(T.train(stream, two, 3, 4)) == want
    assert T.save_checkpoint(T.empty(spark), f"{two}/checkpoints", 3, 3, stream.seed) == b
    with pytest.raises(ValueError):
        T.train(stream.reseed("other"), two, 8, 4)
    # A crash between ledger and checkpoint: the intervals are computed again, their rows stay single.
    first = [tuple(r) for r in spark.read.parquet(f"{two}/checkpoints/manifest").where("step = 2").collect()]
    spark.createDataFrame(first, T.MANIFEST).write.mode("overwrite").parquet(f"{two}/checkpoints/manifest")
    assert key(T.train(stream, two, 6, 4)) == want and T.last_checkpoint(spark, f"{two}/checkpoints") == b
    rest = T.load_checkpoint(spark, f"{two}/checkpoints")[0].collect()[1:]
    spark.createDataFrame(rest, T.MODEL).write.mode("overwrite").parquet(f"{two}/checkpoints/step=6")
    assert not T.verify_checkpoint(spark, f"{two}/checkpoints") and not T.verify_checkpoint(spark, f"{two}/none")
