"""What a run says of itself: its log, and the roll-up of its stored tables into requirements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import packing as P
from textloom.operators import planning as G
from textloom.operators import surprisal as S
from textloom.operators import tokens as K
from textloom.sources.corpus import read_parquet
from textloom.streaming import training as T
from textloom.streaming.batches import LEDGER

# The events that a whole run passes, and its requirements.
EVENTS = ("eval_shard_blocked", "shards_verified", "resume_next_batch_matched", "replay_hash_matched", "throughput_measured")
REQUIREMENTS = ("Tokenizer integrity", "Evaluation firewall", "Packing correctness", "Mixture compliance", "OPUS audit trail", "Crash recovery", "Replay", "Learning trace", "Throughput")
ABSOLUTE = re.compile(r"/|..?:[\\/]")


class RunLog:
    """Lines of a run, without times and without absolute paths, so that equal runs have equal logs. A few lines a stage."""

    def __init__(self):
        self.events: list[tuple[str, str, dict[str, str]]] = []

    def _add(self, level: str, name: str, fields: dict) -> None:
        values = {k: str(v) for k, v in fields.items()}
        if bad := [k for k, v in values.items() if ABSOLUTE.match(v)]:
            raise ValueError(f"an absolute path in {bad}")
        self.events.append((level, name, values))

    def info(self, message: str, **fields) -> None:
        self._add("INFO", message, fields)

    def passed(self, event: str, **fields) -> None:
        self._add("PASS", event, fields)

    def lines(self) -> list[str]:
        return [" ".join([f"[{level}] {name}", *(f"{k}={v}" for k, v in fields.items())]) for level, name, fields in self.events]

    def table(self, spark: SparkSession) -> DataFrame:
        """ord, level, event, line."""
        rows = [(k, e[0], e[1], line) for k, (e, line) in enumerate(zip(self.events, self.lines(), strict=True))]
        return spark.createDataFrame(rows, "ord long, level string, event string, line string")

    def write(self, spark: SparkSession, path: str) -> None:
        """The lines as one text file in a folder."""
        self.table(spark).coalesce(1).orderBy("ord").select("line").write.mode("overwrite").text(path)


def performance(packing: DataFrame, measured: DataFrame) -> DataFrame:
    """One row: the packing report's measures, which never vary, beside the measured throughput, which does."""
    return packing.select("packing_efficiency", "loss_positions", "real_tokens", "padding_tokens").crossJoin(measured)


def audit_checks(shards: DataFrame, index: DataFrame, admitted: DataFrame, tokenizer: tuple, consumption: DataFrame, learning: DataFrame, checkpoints: str, emitted: DataFrame) -> DataFrame:
    """check, ok: the stored tables of a run held against each other.

    admitted: shard_id of what training reads; tokenizer: (vocabulary, merges, the hash that it was frozen with);
    consumption, learning: ledgers with batch_id; checkpoints: their folder; emitted: event. An empty learning ledger
    isn't consistent.
    """
    spark = shards.sparkSession
    vocab, merges, frozen = tokenizer
    one = lambda name, df, c: df.select(F.lit(name).alias("check"), F.coalesce(c, F.lit(False)).alias("ok"))
    given = [("tokenizer_verify", not K.integrity(vocab, merges) and K.tokenizer_hash(vocab, merges) == frozen), ("checkpoint_verify", T.verify_checkpoint(spark, checkpoints))]
    out = spark.createDataFrame(given, "check string, ok boolean")
    out = out.unionByName(one("shards_verify", P.verify_shards(shards, index).agg(F.bool_and("ok").alias("v")), F.col("v")))
    out = out.unionByName(one("firewall_disjoint", G.shards_blocked(index, admitted), F.col("ok")))
    lost = S.unmatched(learning, consumption, "batch_id").agg(F.count("*").alias("lost")).crossJoin(learning.agg(F.count("*").alias("all_")))
    out = out.unionByName(one("ledger_consistent", lost, (F.col("lost") == 0) & (F.col("all_") > 0)))
    expected = spark.createDataFrame([(x,) for x in EVENTS], "event string")
    missing = S.unmatched(expected, emitted, "event").agg(F.count("*").alias("n"))
    return out.unionByName(one("log_complete", missing, F.col("n") == 0))


def requirements(checks: DataFrame, emitted: DataFrame, packing: DataFrame, mixture: DataFrame, decisions: DataFrame, learning: DataFrame, measured: DataFrame) -> DataFrame:
    """ord, requirement, result (PASS or FAIL) of a run's tables: checks as of audit_checks, emitted: event, a packing report,
    a mixture report, selection decisions, the learning ledger and a performance row. What is absent fails."""
    spark = checks.sparkSession
    held = checks.where("ok").select(F.col("check").alias("fact"))
    said = emitted.select(F.concat(F.lit("event "), "event").alias("fact"))
    there = lambda fact, df: df.limit(1).select(F.lit(fact).alias("fact"))
    facts = held.unionByName(said)
    facts = facts.unionByName(there("packed", packing.where("packing_efficiency > 0")))
    facts = facts.unionByName(mixture.agg(F.bool_and("all_floors_met").alias("v")).where("v").select(F.lit("floors").alias("fact")))
    for name, df in (("decided", decisions), ("learnt", learning), ("measured", measured)):
        facts = facts.unionByName(there(name, df))
    needs = (["tokenizer_verify"], ["firewall_disjoint", "event eval_shard_blocked"], ["packed"], ["floors"], ["decided"], ["checkpoint_verify", "event resume_next_batch_matched"], ["event replay_hash_matched"], ["ledger_consistent", "learnt"], ["measured", "event throughput_measured"])
    rows = [(k, name, fact) for k, (name, of) in enumerate(zip(REQUIREMENTS, needs, strict=True)) for fact in of]
    asked = spark.createDataFrame(rows, "ord int, requirement string, fact string")
    both = asked.join(facts.distinct().withColumn("there", F.lit(True)), "fact", "left")
    return both.groupBy("ord", "requirement").agg(F.when(F.bool_and(F.coalesce("there", F.lit(False))), "PASS").otherwise("FAIL").alias("result"))


def markdown(results: DataFrame) -> list[str]:
    """The requirements as lines of a table; they are a closed set, so the driver may hold them."""
    rows = results.orderBy("ord").collect()
    whole = "all requirements pass" if rows and all(r.result == "PASS" for r in rows) else "failures present"
    return ["# Evidence", "", f"**Overall: {whole}**", "", "| Requirement | Result |", "|-|-|", *(f"| {r.requirement} | {r.result} |" for r in rows)]


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(consumption, learning): the ledgers under path, empty where nothing is yet."""
    return read_parquet(spark, f"{path}/ledger", LEDGER), read_parquet(spark, f"{path}/learning", T.LEARNING)
