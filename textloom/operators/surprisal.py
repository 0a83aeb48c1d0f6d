"""Bigram surprisal with add-k smoothing, the scorer in place of a neural model; audits over ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources.tables import written

ADD_K = 1.0
#: Asked pairs of words that may be broadcast.
ASKED = 500_000


def bigrams(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """id, a, b: neighbouring space-parted words of each text, with repeats."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return docs.select(F.col(id_col), w.alias("w")).select(id_col, F.explode(F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("a"), F.element_at("w", i + 1).alias("b"))))).alias("g")).select(id_col, "g.a", "g.b")


def bigram_counts(train: DataFrame, asked: DataFrame) -> tuple[DataFrame, int]:
    """(a, b, n of the training bigrams whose first word is asked; how many words come second in one).

    asked: a, b. Where few are asked, second words that aren't asked after a first word count together as null, so what is
    shuffled follows what is asked; counts are written once for all that is scored by them.
    """
    of, held = asked.select("a", "b").distinct(), bigrams(train)
    firsts = of.select("a").distinct()
    if of.limit(ASKED + 1).count() <= ASKED:
        of, firsts = F.broadcast(of.withColumn("hit", F.lit(True))), F.broadcast(firsts)
        held = held.join(firsts, "a", "left_semi").join(of, ["a", "b"], "left").select("a", F.when(F.col("hit"), F.col("b")).alias("b"))
    else:
        held = held.join(firsts, "a", "left_semi")
    counts = written(held.groupBy("a", "b").agg(F.count("*").alias("n")))
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    seconds = train.select(w.alias("w")).select(F.explode(F.array_distinct(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))))).alias("b"))
    return counts, seconds.distinct().count()


def pair_surprisal(train: DataFrame, pairs: DataFrame, k: float = ADD_K) -> DataFrame:
    """id, tokens, surprisal (summed), per_token of each text of ``pairs`` under the bigrams of ``train``."""
    asked = bigrams(pairs)
    return _scored(asked, *bigram_counts(train, asked), k)


def _scored(asked: DataFrame, counts: DataFrame, v: int, k: float) -> DataFrame:
    contexts = counts.groupBy("a").agg(F.sum("n").alias("m"))
    # Only counts of what is asked are joined back.
    got = asked.join(counts, ["a", "b"], "left").join(contexts, "a", "left")
    p = (F.coalesce("n", F.lit(0)) + k) / (F.coalesce("m", F.lit(0)) + k * v)
    return got.groupBy("id").agg(F.count("*").alias("tokens"), F.sum(-F.log(p)).alias("s")).select("id", "tokens", F.round("s", 4).alias("surprisal"), F.round(F.col("s") / F.col("tokens"), 4).alias("per_token"))


def delta_s(minus: DataFrame, plus: DataFrame) -> DataFrame:
    """id, delta_s_sum, delta_s_per_token: surprisal of the one continuation less that of the other, summed and per token."""
    a, b = minus.select("id", F.col("surprisal").alias("x"), F.col("per_token").alias("y")), plus.select("id", F.col("surprisal").alias("u"), F.col("per_token").alias("v"))
    return a.join(b, "id").select("id", F.round(F.col("x") - F.col("u"), 4).alias("delta_s_sum"), F.round(F.col("y") - F.col("v"), 4).alias("delta_s_per_token"))


def contrast(train: DataFrame, pairs: DataFrame, k: float = ADD_K) -> DataFrame:
    """delta_s of contrastive pairs: each is two texts, its prefix with either continuation."""
    minus, plus = (bigrams(pairs.select("id", F.concat_ws(" ", "prefix", c).alias("text"))) for c in ("y_minus", "y_plus"))
    counts, v = bigram_counts(train, minus.unionByName(plus))
    return delta_s(_scored(minus, counts, v, k), _scored(plus, counts, v, k))


def unmatched(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the other table: learning without consumption, expected events that weren't emitted."""
    return rows.join(of.select(key).distinct(), key, "left_anti")


def audit(checks: dict[str, DataFrame]) -> DataFrame:
    """check, violations, ok: each check is a DataFrame of violations."""
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out
