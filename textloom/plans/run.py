"""The whole chain: evaluation split, cleaning, tokenizer, shards, firewall, mixture, selection, packing, batches, training, audit, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import packing as P
from textloom.operators import planning as G
from textloom.operators import surprisal as S
from textloom.operators import tokens as K
from textloom.plans import clean as plan
from textloom.plans import evidence as E
from textloom.sources.tables import written
from textloom.streaming import batches as B
from textloom.streaming import training as T


def shard_candidates(shards: DataFrame) -> DataFrame:
    """id, pos, lane, tokens, quality, delta_s of training shards: quality is the mean of their documents' tiers."""
    each = shards.where("split = 'train'").select("shard_id", "lane", "bin", "n_tokens", F.explode("docs").alias("d"))
    quality = F.avg(G.tier_quality(F.col("d.provenance_tier")))
    rows = each.groupBy("shard_id", "lane", "bin", "n_tokens").agg(F.round(quality, 6).alias("quality"))
    return rows.select(F.col("shard_id").alias("id"), F.col("bin").alias("pos"), "lane", F.col("n_tokens").alias("tokens"), "quality", F.lit(0.0).alias("delta_s"))


def run(docs: DataFrame, held: DataFrame, pairs: DataFrame, path: str, vocab_size: int = 400, steps: int = 8, seq_len: int = P.SEQ_LEN, cap: int = P.SHARD_TOKENS) -> DataFrame:
    """stage, measure, value of every stage, in rows. docs: corpus records; held: more texts that training may not hold;
    path: where split, shards, ledgers, checkpoints and the log go."""
    spark, facts = docs.sparkSession, []

    def note(stage: str, df: DataFrame) -> None:
        pairs_ = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in df.columns]))
        facts.append(df.select(pairs_.alias("f")).select(F.lit(stage).alias("stage"), "f.measure", "f.value"))

    note("split", G.carve_eval(docs, f"{path}/eval").drop("fingerprint"))
    eval_ids = G.load_eval_ids(spark, f"{path}/eval")
    routed = written(G.route(docs, eval_ids))
    evaluation = routed.where("split = 'eval'")
    texts = evaluation.select("id", "text").unionByName(held.select("id", "text"))
    left, drops, masked = plan.clean(routed.where("split = 'train'"), texts, pairs=pairs)
    left = written(left)
    note("clean", plan.report(routed.where("split = 'train'"), drops, masked).where("stage = 'decontam'").select("kept"))
    vocab, merges = K.train(left, vocab_size)
    note("tokenizer", spark.createDataFrame([(len(vocab), len(K.integrity(vocab, merges)))], "vocabulary int, problems int"))
    frozen = K.tokenizer_hash(vocab, merges)
    both = left.unionByName(evaluation.withColumn("text", X.normalize(F.col("text"))))
    tokens = K.encode(both, vocab, merges)
    P.write_shards(P.shards(both.join(tokens, "id"), vocab["<bos>"], vocab["<eos>"], cap), f"{path}/shards")
    shards = P.read_shards(spark, f"{path}/shards")
    index = spark.read.parquet(f"{path}/shards/index")
    note("shards", index.agg(F.count("*").alias("shards"), F.sum("n_tokens").alias("tokens")))
    note("verify", P.verify_shards(shards, index).agg(F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("broken")))
    train = index.where("split = 'train'")
    blocked = G.shards_blocked(index, train)
    note("firewall", blocked)
    total = index.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    mix = written(G.compile_mixture(G.mixture_rows(spark), total))
    note("mixture", mix.agg(F.bool_and("meets_floor").cast("int").alias("all_floors_met")))
    limits = mix.groupBy("lane").agg(F.sum("planned_tokens").alias("target")).join(G.floor_tokens(mix), "lane").select("lane", "target", F.col("floor_tokens").alias("floor"))
    decisions = written(G.select(shard_candidates(index), limits))
    note("select", G.select_summary(decisions).agg(*[F.sum(c).alias(c) for c in ("accept", "reject", "defer", "accepted_tokens")]))
    accepted = shards.join(decisions.where("decision = 'accept'").select(F.col("id").alias("shard_id")), "shard_id", "left_semi")
    offered = P.iter_docs(accepted, "train")
    packed = written(P.pack(offered, seq_len))
    note("pack", P.packing_report(offered, packed, seq_len))
    stream = B.BatchStream(packed.select("seq", "lane", "tokens", "loss_mask", F.expr("aggregate(loss_mask, 0L, (s, x) -> s + x)").alias("n_loss")))
    first = B.consume(stream, f"{path}/ledger", steps // 2)
    rest = B.consume(stream, f"{path}/ledger", steps)
    ledger = spark.read.parquet(f"{path}/ledger")
    note("ledger", ledger.agg(F.count("*").alias("batches"), F.countDistinct("batch_index").alias("distinct"), F.sum("n_loss").alias("loss_positions")))
    replayed = B.replay(stream, ledger, 0, steps)
    note("replay", replayed.agg(F.sum(F.when(F.col("matched"), 1).otherwise(0)).alias("matched")))
    learning = T.train(stream, path, steps, len(vocab), every=max(1, steps // 2))
    note("train", learning.agg(F.count("*").alias("batches"), F.sum("n_loss").alias("loss_positions"), F.min_by("loss_nats", "batch_index").alias("first_loss"), F.max_by("loss_nats", "batch_index").alias("last_loss")))
    measured = T.throughput(stream, max(1, steps // 2), len(vocab))
    verified = P.verify_shards(shards, index).agg(F.bool_and("ok").alias("ok")).where("ok")
    # In the order of EVENTS.
    passed = [blocked.where("ok"), verified, rest.join(first, "batch_index", "left_anti").limit(1), replayed.agg(F.bool_and("matched").alias("ok")).where("ok"), measured.where("loss_tokens_per_sec > 0")]
    emitted = written(reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("ord"), F.lit(event).alias("event")) for k, (df, event) in enumerate(zip(passed, E.EVENTS, strict=True))]))
    expected = spark.createDataFrame([(x,) for x in E.EVENTS], "event string")
    log = E.RunLog()
    log.info("tokenizer trained", vocabulary=len(vocab), merges=len(merges))
    for r in emitted.orderBy("ord").collect():
        log.passed(r.event)
    log.write(spark, f"{path}/log")
    checks = S.audit({"leaked documents": offered.join(eval_ids, "id", "left_semi"), "events not emitted": S.unmatched(expected, emitted, "event"), "batches not consumed": S.unmatched(stream.batches(0, steps).select("batch_id"), ledger, "batch_id")})
    facts.append(checks.select(F.lit("audit").alias("stage"), F.col("check").alias("measure"), F.col("violations").cast("double").alias("value")))
    # Seconds differ from run to run, so they have a table of their own.
    E.performance(P.packing_report(offered, packed, seq_len), measured).write.mode("overwrite").parquet(f"{path}/performance")
    found = E.audit_checks(shards, index, train, (vocab, merges, frozen), ledger, learning, f"{path}/checkpoints", emitted)
    results = E.requirements(written(found), emitted, P.packing_report(offered, packed, seq_len), G.mixture_report(mix), decisions, learning, spark.read.parquet(f"{path}/performance"))
    facts.append(results.select(F.lit("evidence").alias("stage"), F.col("requirement").alias("measure"), (F.col("result") == "PASS").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, facts)
