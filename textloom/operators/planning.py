"""Counts, validation, evaluation split, firewall, mixture and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators.order import fresh, positions, sums_before
from textloom.sources.corpus import EVAL_FRACTION, EVAL_SEED, EVAL_TIERS, LANES, SPLITS, TIERS, read_parquet

# The curriculum's phases with their shares, lane weights and protected floors; quality of tiers; thresholds.
PHASES = [
    ("warmup", 0.3, {"web": 0.40, "code": 0.20, "math": 0.15, "indic": 0.20, "multilingual": 0.05}, {"indic": 0.15, "multilingual": 0.03}),
    ("india_emphasis", 0.7, {"web": 0.25, "code": 0.15, "math": 0.10, "indic": 0.40, "multilingual": 0.10}, {"indic": 0.35, "multilingual": 0.08}),
]
TIER_QUALITY = {"T0": 1.0, "T1": 0.9, "T2": 0.6, "T3": 0.4}
ACCEPT, REJECT, DELTA_WEIGHT = 0.5, 0.2, 0.3
# What a contrastive pair must say of its vantage.
VANTAGE, CHAUVINISM = "indian_plus_western_minus", "none"


def violation(eval_tiers=EVAL_TIERS) -> Column:
    """The first rule that a document breaks, null if none."""
    blank = lambda c: F.col(c).isNull() | (F.length(F.regexp_replace(F.col(c), r"(?U)\s+", "")) == 0)
    return (
        F.when(blank("id"), "id").when(blank("lane") | ~F.col("lane").isin(*LANES), "lane").when(blank("provenance_tier") | ~F.col("provenance_tier").isin(*TIERS), "provenance_tier")
        .when(blank("split") | ~F.col("split").isin(*SPLITS), "split").when(blank("source"), "source").when(blank("text"), "text")
        .when((F.col("split") == "eval") & ~F.col("provenance_tier").isin(*eval_tiers), "eval tier")
    )


def minted_pairs(spec: DataFrame, order: str = "pos") -> DataFrame:
    """Contrastive pairs (id, topic, prefix, y_plus, y_minus, vantage, chauvinism) of a table with their texts; ids count
    from 1 in order."""
    numbered = positions(spec.select(F.col(order).alias("order_"), "topic", "prefix", "y_plus", "y_minus"), "order_")
    return numbered.select(F.format_string("pair-%04d", F.col("pos") + 1).alias("id"), "topic", "prefix", "y_plus", "y_minus", F.lit(VANTAGE).alias("vantage"), F.lit(CHAUVINISM).alias("chauvinism"))


def pair_violation() -> Column:
    """The first rule that a contrastive pair breaks: blank fields, other constants, equal continuations."""
    blank = lambda c: F.col(c).isNull() | (F.length(F.trim(F.col(c))) == 0)
    out = F.when(blank("id"), "id")
    for c in ("topic", "prefix", "y_plus", "y_minus"):
        out = out.when(blank(c), c)
    out = out.when(~F.col("vantage").eqNullSafe(VANTAGE), "vantage").when(~F.col("chauvinism").eqNullSafe(CHAUVINISM), "chauvinism")
    return out.when(F.trim("y_plus") == F.trim("y_minus"), "no contrast")


def pair_tokens(pairs: DataFrame) -> DataFrame:
    """One row: pairs, and their tokens, each pair being two sequences."""
    both = [X.est_tokens(F.concat_ws(" ", "prefix", c)) for c in ("y_plus", "y_minus")]
    return pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum(both[0] + both[1]), F.lit(0)).alias("tokens"))


def duplicate_ids(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def select_eval(docs: DataFrame, fraction: float = EVAL_FRACTION, seed: str = EVAL_SEED) -> DataFrame:
    """id, est_tokens of the evaluation split: eligible documents by the hash of seed and id, until the target is reached."""
    pool, n = docs.agg(F.coalesce(F.sum("est_tokens"), F.lit(0)), F.count("*")).first()
    target = round(fraction * pool)
    digits = max(3, len(f"{n // 4096:x}"))  # ranges of hashes, some thousand documents each at most
    ordered = docs.where(F.col("provenance_tier").isin(*EVAL_TIERS)).select("id", "est_tokens", F.sha2(F.concat(F.lit(f"{seed}:"), "id").cast("binary"), 256).alias("h"))
    return sums_before(ordered, [], "h", F.substring("h", 1, digits), before_=F.col("est_tokens")).where(F.col("before_") < target).select("id", "est_tokens")


def fingerprint(ids: DataFrame) -> DataFrame:
    """One hash over the sorted ids of a small split."""
    return ids.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n").cast("binary"), 256).alias("fingerprint"))


def carve_eval(docs: DataFrame, path: str, fraction: float = EVAL_FRACTION, seed: str = EVAL_SEED) -> DataFrame:
    """Writes the evaluation split under path: manifest (its ids), documents (whole, as split eval) and header, last.

    One row comes back: selected_count, selected_tokens, fingerprint, cached. If the header there has the fingerprint of
    this selection, nothing is written and cached is true.
    """
    chosen = select_eval(docs, fraction, seed).join(docs.select("id", "source_id", "lane", "provenance_tier"), "id")
    now = chosen.agg(F.count("*").alias("selected_count"), F.coalesce(F.sum("est_tokens"), F.lit(0)).alias("selected_tokens")).crossJoin(fingerprint(chosen)).first()
    spark = docs.sparkSession
    header = spark.createDataFrame([tuple(now)], "selected_count long, selected_tokens long, fingerprint string")
    last = read_parquet(spark, f"{path}/header", "selected_count long, selected_tokens long, fingerprint string").first()
    cached = last is not None and last.fingerprint == now.fingerprint
    if not cached:
        chosen.withColumn("split", F.lit("eval")).write.mode("overwrite").parquet(f"{path}/manifest")
        kept = docs.join(load_eval_ids(spark, path), "id", "left_semi").withColumn("split", F.lit("eval"))
        outside = F.when(F.col("provenance_tier").isin(*EVAL_TIERS), F.col("split")).otherwise(F.raise_error(F.concat(F.lit("tier of "), "id")))
        kept.withColumn("split", outside).write.mode("overwrite").parquet(f"{path}/documents")
        header.write.mode("overwrite").parquet(f"{path}/header")
    return header.withColumn("cached", F.lit(cached))


def load_eval_ids(spark: SparkSession, path: str) -> DataFrame:
    """id of every document of a carved split."""
    return spark.read.parquet(f"{path}/manifest").select("id")


def route(docs: DataFrame, eval_ids: DataFrame) -> DataFrame:
    """docs with their split: eval if the id is in the manifest, else train."""
    (name,) = fresh(docs, "eval_")
    mark = eval_ids.select("id").distinct().withColumn(name, F.lit(True))
    return docs.join(mark, "id", "left").withColumn("split", F.when(F.col(name), "eval").otherwise("train")).drop(name)


def dangling(eval_ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Ids of the manifest that no document has."""
    return eval_ids.select("id").join(docs.select("id"), "id", "left_anti")


def guarded(docs: DataFrame, eval_ids: DataFrame) -> DataFrame:
    """docs without evaluation ids; a document marked as evaluation data stops the job."""
    out = docs.join(eval_ids.select("id"), "id", "left_anti")
    return out.withColumn("split", F.when(F.col("split") == "train", F.col("split")).otherwise(F.raise_error(F.concat(F.lit("not training data: "), "id")))) if "split" in docs.columns else out


def corpus_counts(docs: DataFrame) -> DataFrame:
    """lane, split, docs, tokens, with zeros for lanes and splits without documents."""
    spark = docs.sparkSession
    grid = spark.createDataFrame([(a, b) for a in LANES for b in SPLITS], "lane string, split string")
    got = docs.groupBy("lane", "split").agg(F.count("*").alias("docs"), F.sum("est_tokens").alias("tokens"))
    return grid.join(got, ["lane", "split"], "left").select("lane", "split", F.coalesce("docs", F.lit(0)).cast("long").alias("docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def corpus_summary(counts: DataFrame) -> DataFrame:
    """Each lane's tokens and its share of all, rounded; zero where there is nothing."""
    by = counts.groupBy("lane").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return by.select("lane", "docs", "tokens", F.coalesce(F.bround(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())), 6), F.lit(0.0)).alias("share"))


def apportion(df: DataFrame, keys: list[str], budget: Column, weight: str, name: str, out: str) -> DataFrame:
    """Whole parts of the budget in proportion to the weights; what is left goes to the largest fractions, ties by name."""
    group = Window.partitionBy(*keys)
    exact = F.when(F.sum(weight).over(group) > 0, budget * F.col(weight) / F.sum(weight).over(group)).otherwise(0.0)
    df = df.withColumn("_exact", exact).withColumn("_whole", F.floor("_exact"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.col("_exact") - F.col("_whole")), name))
    left = F.when(F.sum(weight).over(group) > 0, budget - F.sum("_whole").over(group)).otherwise(0)
    return df.withColumn(out, (F.col("_whole") + F.when(place <= left, 1).otherwise(0)).cast("long")).drop("_exact", "_whole")


def mixture_rows(spark: SparkSession, phases=None) -> DataFrame:
    """(phase, fraction, lane, weight, floor) of the phases, after their checks."""
    phases = PHASES if phases is None else phases
    if abs(sum(p[1] for p in phases) - 1) > 1e-6:
        raise ValueError("the phases' fractions don't sum to 1")
    for name, _, weights, floors in phases:
        if min(weights.values()) < 0 or sum(weights.values()) <= 0:
            raise ValueError(f"weights of {name}")
        if not all(0 <= x <= 1 for x in floors.values()) or sum(floors.values()) > 1 or not floors.keys() <= weights.keys():
            raise ValueError(f"floors of {name}")
    return spark.createDataFrame([(n, float(f), lane, float(w), float(fl.get(lane, 0.0))) for n, f, ws, fl in phases for lane, w in ws.items()], "phase string, fraction double, lane string, weight double, floor double")


def compile_mixture(rows: DataFrame, total: int) -> DataFrame:
    """phase, lane, budget, planned_tokens, planned_share, floor, meets_floor: floors first, what is left by weight."""
    budgets = apportion(rows.select("phase", "fraction").distinct(), [], F.lit(float(total)), "fraction", "phase", "budget").select("phase", "budget")
    plan = rows.join(budgets, "phase").withColumn("floor_tokens", (F.col("floor") * F.col("budget")).cast("long"))
    plan = plan.withColumn("_rest", F.col("budget") - F.sum("floor_tokens").over(Window.partitionBy("phase")))
    plan = apportion(plan, ["phase"], F.col("_rest"), "weight", "lane", "_by_weight")
    planned = F.col("floor_tokens") + F.col("_by_weight")
    return plan.select("phase", "lane", "budget", planned.alias("planned_tokens"), F.round(planned / F.col("budget"), 6).alias("planned_share"), "floor", (planned >= F.col("floor_tokens")).alias("meets_floor"))


def floor_tokens(plan: DataFrame) -> DataFrame:
    """lane, floor_tokens: protected tokens over all phases, cut to whole numbers phase by phase."""
    return plan.groupBy("lane").agg(F.sum((F.col("floor") * F.col("budget")).cast("long")).alias("floor_tokens"))


def mixture_report(plan: DataFrame) -> DataFrame:
    """lane, planned_tokens over all phases, all_floors_met (of the whole plan, on every row)."""
    met = plan.agg(F.bool_and("meets_floor").alias("all_floors_met"))
    return plan.groupBy("lane").agg(F.sum("planned_tokens").alias("planned_tokens")).crossJoin(met)


def mixture_coverage(plan: DataFrame, available: DataFrame) -> DataFrame:
    """lane, planned, available, needs_repetition over the lanes of either side."""
    totals = plan.groupBy("lane").agg(F.sum("planned_tokens").alias("planned"))
    both = totals.join(available.select("lane", F.col("tokens").alias("available")), "lane", "full_outer")
    planned, there = F.coalesce("planned", F.lit(0)).cast("long"), F.coalesce("available", F.lit(0)).cast("long")
    return both.select("lane", planned.alias("planned"), there.alias("available"), (planned > there).alias("needs_repetition"))


def tier_quality(tier: Column) -> Column:
    out = F.lit(0.0)
    for t, q in TIER_QUALITY.items():
        out = F.when(tier == t, q).otherwise(out)
    return out


def select(candidates: DataFrame, limits: DataFrame, accept: float = ACCEPT, reject: float = REJECT, delta_weight: float = DELTA_WEIGHT, score: Column | None = None) -> DataFrame:
    """Decisions on candidates (id, lane, tokens, quality, delta_s) in the order of pos, or of ids, with running lane totals.

    limits: lane, target, floor; lanes without a row have none. While a lane is below its floor everything is taken, so
    the running sum of all tokens decides; after that only good scores add, so a second running sum decides, and once a
    lane has reached its target nothing more is taken. Tokens must be positive.
    """
    if "pos" not in candidates.columns:
        candidates = positions(candidates, "id")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("quality") + delta_weight * F.col("delta_s"))) if score is None else score
    # Lanes are a closed set, so limits are few.
    c = candidates.join(F.broadcast(limits), "lane", "left").fillna(0, ["target", "floor"]).withColumn("score", score)
    c = sums_before(c, ["lane"], "pos", all_=F.col("tokens"))
    c = c.withColumn("floored_", F.col("all_") < F.col("floor"))
    c = sums_before(c, ["lane"], "pos", used_=F.when(F.col("floored_") | (F.col("score") >= accept), F.col("tokens")).otherwise(0))
    full = F.col("used_") >= F.col("target")
    c = c.withColumn("decision", F.when(F.col("floored_"), "accept").when(full, "reject").when(F.col("score") >= accept, "accept").when(F.col("score") >= reject, "defer").otherwise("reject"))
    c = c.withColumn("reason", F.when(F.col("floored_"), "floor_override").when(full, "lane_target_reached").when(F.col("score") >= accept, "score>=accept").when(F.col("score") >= reject, "marginal_score").otherwise("score<reject"))
    c = sums_before(c, ["lane"], "pos", taken_=F.when(F.col("decision") == "accept", F.col("tokens")).otherwise(0))
    after = F.col("taken_") + F.when(F.col("decision") == "accept", F.col("tokens")).otherwise(0)
    return c.select("id", "lane", "tokens", F.round("score", 4).alias("score"), F.round("delta_s", 4).alias("delta_s"), "decision", "reason", after.cast("long").alias("lane_total_after"))


def select_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("lane").agg(*[F.sum(F.when(F.col("decision") == d, 1).otherwise(0)).alias(d) for d in ("accept", "reject", "defer")], F.sum(F.when(F.col("decision") == "accept", F.col("tokens")).otherwise(0)).cast("long").alias("accepted_tokens"))


def firewall_audit(docs: DataFrame, eval_ids: DataFrame) -> DataFrame:
    """One row: training and evaluation ids, how many are both, and whether none is."""
    train = docs.where("split = 'train'").select("id")
    both = train.join(eval_ids.select("id"), "id", "left_semi")
    one = lambda df, c: df.agg(F.count("*").alias(c))
    return one(train, "n_train").crossJoin(one(eval_ids, "n_eval")).crossJoin(one(both, "n_leaked")).withColumn("ok", F.col("n_leaked") == 0)


def shards_blocked(shards: DataFrame, admitted: DataFrame) -> DataFrame:
    """One row: train_shards, eval_shards, blocked (evaluation shards that aren't admitted), ok. shards: shard_id, split;
    admitted: shard_id of what training reads."""
    mark = admitted.select("shard_id").distinct().withColumn("in_", F.lit(True))
    both = shards.join(mark, "shard_id", "left")
    eval_, there = F.col("split") == "eval", F.coalesce("in_", F.lit(False))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return both.agg(n(~eval_).alias("train_shards"), n(eval_).alias("eval_shards"), n(eval_ & ~there).alias("blocked")).withColumn("ok", F.col("blocked") == F.col("eval_shards"))
