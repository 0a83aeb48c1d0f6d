"""A bigram scorer trained batch by batch: losses, a learning ledger, and checkpoints that a run resumes from.

The model is a table of counts (a, b, n) of neighbouring tokens; the loss of a batch is taken under the counts of all
batches before it, so a range of batches is one plan, and a resumed run has the losses of one that wasn't interrupted.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from textloom.sources.corpus import append, read_parquet
from textloom.sources.tables import written
from textloom.streaming.batches import BatchStream

MODEL = "a int, b int, n long"
LEARNING = "batch_index long, batch_id string, n_loss long, loss_nats double"
MANIFEST = "step long, ledger_offset long, seed string, model_hash string, n_pairs long"


def transitions(stream: BatchStream, start: int, stop: int) -> DataFrame:
    """batch_index, a, b, n: neighbouring tokens of the batches' sequences, where loss_mask (a column of the stream's
    sequences) counts them; drawn twice, a sequence counts twice."""
    rows = stream.slots(start, stop).join(stream.placed, ["lane", "place"]).join(stream.sequences, ["lane", "seq"])
    last = F.greatest(F.size("tokens") - 1, F.lit(0))
    steps = F.arrays_zip(F.slice("tokens", 1, last).alias("a"), F.slice("tokens", 2, last).alias("b"), F.slice("loss_mask", 1, last).alias("m"))
    each = rows.select("batch_index", F.explode(F.filter(steps, lambda x: x["m"] == 1)).alias("s"))
    return each.groupBy("batch_index", F.col("s.a").cast("int").alias("a"), F.col("s.b").cast("int").alias("b")).agg(F.count("*").alias("n"))


def empty(spark: SparkSession) -> DataFrame:
    """The model before any batch."""
    return spark.createDataFrame([], MODEL)


def train_range(stream: BatchStream, model: DataFrame, start: int, stop: int, vocab_size: int, k: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(losses: batch_index, n_loss, loss_nats; the model after them). loss_nats is the mean surprisal of a batch's scored
    tokens; batches without any are absent.

    Counts of a pair are summed up over batches, at most one row a batch; call it for one checkpoint's interval at a time.
    """
    new = written(transitions(stream, start, stop))
    # What the model held comes before the first batch.
    old = model.select(F.lit(start - 1).cast("long").alias("batch_index"), "a", "b", "n")
    upto = lambda *keys: Window.partitionBy(*keys).orderBy("batch_index").rowsBetween(Window.unboundedPreceding, -1)
    both = new.unionByName(old)
    pairs = both.withColumn("of_pair", F.coalesce(F.sum("n").over(upto("a", "b")), F.lit(0))).where(F.col("batch_index") >= start)
    contexts = both.groupBy("a", "batch_index").agg(F.sum("n").alias("m")).withColumn("of_a", F.coalesce(F.sum("m").over(upto("a")), F.lit(0)))
    p = (F.col("of_pair") + k) / (F.col("of_a") + k * vocab_size)
    # Sums of rounded terms don't depend on the order of rows.
    nats = F.sum((F.col("n") * -F.log(p)).cast("decimal(38,9)")).cast("double") / F.sum("n")
    losses = pairs.join(contexts, ["a", "batch_index"]).groupBy("batch_index").agg(F.sum("n").alias("n_loss"), F.round(nats, 6).alias("loss_nats"))
    return losses, both.groupBy("a", "b").agg(F.sum("n").alias("n"))


def model_hash(model: DataFrame) -> Row:
    """model_hash, n_pairs of a model; the order of its rows makes no difference."""
    one = F.sum(F.xxhash64("a", "b", "n").cast("decimal(38,0)"))
    text = F.concat_ws(":", F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(one, F.lit(0)))
    return model.agg(F.sha2(text, 256).alias("model_hash"), F.count("*").alias("n_pairs")).first()


def last_checkpoint(spark: SparkSession, path: str) -> Row | None:
    """The manifest of the latest checkpoint under path."""
    return read_parquet(spark, f"{path}/manifest", MANIFEST).orderBy(F.desc("step")).first()


def save_checkpoint(model: DataFrame, path: str, step: int, ledger_offset: int, seed: str) -> Row:
    """Writes the model, then its manifest, and returns the manifest; what has no manifest doesn't count. Steps and offsets
    never fall: at a step that isn't beyond the last one nothing is written and the last manifest is returned."""
    spark = model.sparkSession
    last = last_checkpoint(spark, path)
    if last and step <= last.step:
        return last
    model.write.mode("overwrite").parquet(where := f"{path}/step={step}")
    stored = model_hash(spark.read.schema(MODEL).parquet(where))
    row = (step, max(ledger_offset, last.ledger_offset if last else 0), seed, stored.model_hash, stored.n_pairs)
    append(spark.createDataFrame([row], MANIFEST).coalesce(1), f"{path}/manifest")
    return last_checkpoint(spark, path)


def load_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, Row | None]:
    """(the latest model, its manifest); an empty model and None where there is no checkpoint."""
    last = last_checkpoint(spark, path)
    return (spark.read.schema(MODEL).parquet(f"{path}/step={last.step}"), last) if last else (empty(spark), None)


def verify_checkpoint(spark: SparkSession, path: str) -> bool:
    """Whether the latest model is what its manifest says; no checkpoint is not."""
    model, last = load_checkpoint(spark, path)
    return last is not None and model_hash(model).model_hash == last.model_hash


def train(stream: BatchStream, path: str, target: int, vocab_size: int, every: int = 100) -> DataFrame:
    """Trains until the batch before target, from the last checkpoint in path/checkpoints on, with a checkpoint after each
    ``every`` batches, and returns the learning ledger (LEARNING) of path/learning. A target that was passed trains nothing.

    After a crash between ledger and checkpoint the interval is computed again; its rows are in the ledger once.
    """
    spark = stream.sequences.sparkSession
    model, last = load_checkpoint(spark, f"{path}/checkpoints")
    if last and last.seed != stream.seed:
        raise ValueError("the checkpoint is of another seed")
    at = last.ledger_offset if last else 0
    while at < target:
        stop = min(target, at + every)
        losses, model = train_range(stream, model, at, stop, vocab_size)
        ids = stream.batches(at, stop).select("batch_index", "batch_id")
        rows = written(losses.join(ids, "batch_index").select("batch_index", "batch_id", "n_loss", "loss_nats"))
        append(rows.join(read_parquet(spark, f"{path}/learning", LEARNING).select("batch_index"), "batch_index", "left_anti"), f"{path}/learning")
        save_checkpoint(model, f"{path}/checkpoints", stop, stop, stream.seed)
        model, at = load_checkpoint(spark, f"{path}/checkpoints")[0], stop
    return read_parquet(spark, f"{path}/learning", LEARNING)


def throughput(stream: BatchStream, steps: int, vocab_size: int) -> DataFrame:
    """One row: steps, loss_tokens, seconds, loss_tokens_per_sec of training on that many batches. Seconds differ from run
    to run, so they belong into no log or hash."""
    spark, start = stream.sequences.sparkSession, time.perf_counter()
    losses, model = train_range(stream, empty(spark), 0, steps, vocab_size)
    model_hash(model)
    n = losses.agg(F.coalesce(F.sum("n_loss"), F.lit(0))).first()[0]
    seconds = time.perf_counter() - start
    return spark.createDataFrame([(steps, n, round(seconds, 4), round(n / seconds, 2) if seconds > 0 else 0.0)], "steps long, loss_tokens long, seconds double, loss_tokens_per_sec double")
