"""Line deduplication by pairwise alignment.

Documents overlap if they share a leading line: one of MIN_WORDS words or MIN_CHARS characters or more. A line that at
most RARE documents have pairs each of them with every earlier one. A line that more have pairs each of them with its
holder, the earliest document that has it, so a line that thousands share gives a star and never all pairs; that is the
exact way for common lines. A pair is aligned by patience diff over line hashes: lines that are unique in both documents
and keep their order are anchors, blocks grow from them over equal neighbours, and what lies between two blocks is
aligned in the same way. Aligned common blocks are deleted from the later document, and so is each leading line that the
blocks leave over though the earlier document has it: where a line repeats in either document, or blocks cross, there is
no anchor for it. So of a leading line only the copies in its earliest document stay, and no line vanishes.

Of a pair the shorter document's line hashes travel to the longer one, so a long document that thousands share a line
with isn't repeated for each of them. Whole texts meet what is deleted from them only where something is: changed rows
are told by bitmaps, the others stay where they are.

Defined cases: shorter lines pair no documents and stay, unless a block spans them; a null text is the empty text;
documents are ordered by id (null last), rows that repeat an id by their place; repeats within one document stay if no
earlier document has the line; an empty table gives an empty result; other columns, whatever their names, are carried
along. Lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import body, fresh, marked, marks, rid, stable, table, written

MIN_WORDS, MIN_CHARS = 5, 30
#: Documents that may share a line and still be paired with each other, not only with the earliest.
RARE = 4


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of aligned common blocks, ascending in both."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and in_b.get(x) == 1}
        shared = [(where[x], j) for j, x in enumerate(b[b0:b1], b0) if x in where]
        # Longest ascending run of places in a, in the order of b.
        tails, at, link = [], [], [-1] * len(shared)
        for k, (i, _) in enumerate(shared):
            t = bisect_left(tails, i)
            link[k] = at[t - 1] if t else -1
            if t == len(tails):
                tails.append(i)
                at.append(k)
            else:
                tails[t], at[t] = i, k
        chain, k = [], at[-1] if at else -1
        while k >= 0:
            chain.append(shared[k])
            k = link[k]
        low_a, low_b = a0, b0
        for i, j in reversed(chain):
            if i < low_a or j < low_b:
                continue  # a block before has grown over it
            s, n = 0, 1
            while i - s > low_a and j - s > low_b and a[i - s - 1] == b[j - s - 1]:
                s += 1
            while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
                n += 1
            work.append((low_a, i - s, low_b, j - s))
            out.append((i - s, j - s, s + n))
            low_a, low_b = i + n, j + n
        if chain:
            work.append((low_a, a1, low_b, b1))
    return sorted(out)


def shared_places(a: list[int], b: list[int], lead: set[int]) -> list[int]:
    """Places in b to delete: of the aligned blocks, and of what they leave over each line of ``lead`` that a holds."""
    gone = {j + k for _, j, n in patience(a, b) for k in range(n)}
    held = lead.intersection(a)
    return sorted(gone.union(j for j, x in enumerate(b) if x in held))


def _leading(line: Column, min_words: int) -> Column:
    return (F.length(F.trim(line)) >= MIN_CHARS) | (F.size(F.split(F.trim(line), r"\s+")) >= min_words)


def line_rows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rid, place (what orders documents), n, seq (hash of each line), lead (distinct hashes of leading lines) of every row."""
    lines = docs.select(rid(docs).alias("rid"), "doc_id", F.split(body(), "\n").alias("lines"))
    hashed = F.transform("lines", lambda x: F.xxhash64(x))
    lead = F.array_distinct(F.transform(F.filter("lines", lambda x: _leading(x, min_words)), lambda x: F.xxhash64(x)))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "rid", F.size("lines").alias("n"))
    return lines.select("rid", place.alias("place"), hashed.alias("seq"), lead.alias("lead"))


def pairs(rows: DataFrame, rare: int = RARE) -> DataFrame:
    """early, late: places of documents that share a leading line, each pair once."""
    each = rows.select("place", F.explode("lead").alias("line"))
    # Counts and minima combine before the shuffle. What joins them is read again, so that a hot line's rows can be split.
    counts = written(each.groupBy("line").agg(F.count("*").alias("n"), F.min("place").alias("early")).where("n > 1"))
    common = each.join(counts.where(F.col("n") > rare), "line").select("early", F.col("place").alias("late"))
    few = each.join(counts.where(F.col("n") <= rare).select("line"), "line").groupBy("line").agg(F.array_sort(F.collect_list("place")).alias("p"))
    both = F.transform(F.col("p"), lambda x, i: F.transform(F.slice("p", 1, i), lambda e: F.struct(e.alias("early"), x.alias("late"))))
    found = few.select(F.explode(F.flatten(both)).alias("b")).select("b.early", "b.late").unionByName(common.where("early.rid <> late.rid"))
    return found.distinct()


def removals(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """rid and gone (ascending places of lines to delete) of the rows of a stable table that lose lines."""
    rows = written(line_rows(docs, min_words))
    found = written(pairs(rows, rare).select(F.col("early.rid").alias("early"), F.col("late.rid").alias("late"), (F.col("early.n") <= F.col("late.n")).alias("up")))
    early = rows.select(F.col("rid").alias("early"), F.col("seq").alias("a"))
    late = rows.select(F.col("rid").alias("late"), F.col("seq").alias("b"), "lead")
    up = found.where("up").drop("up").join(early, "early").select("late", "a").join(late, "late")
    down = found.where("NOT up").drop("up").join(late, "late").join(early, "early")
    both = up.select("late", "a", "b", "lead").unionByName(down.select("late", "a", "b", "lead"))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone = [shared_places(list(a), list(b), set(c)) for a, b, c in zip(batch["a"], batch["b"], batch["lead"], strict=True)]
            yield pd.DataFrame({"file": batch["file"], "row": batch["row"], "gone": gone})

    cut = both.select("late.file", "late.row", "a", "b", "lead").mapInPandas(align, "file long, row long, gone array<int>")
    each = cut.select(F.struct("file", "row").alias("rid"), F.explode("gone").alias("at"))
    return each.groupBy("rid").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """docs with deduplicated texts, and n_lines and n_removed, which take the place of columns of those names."""
    docs = stable(docs)
    gone = written(removals(docs, min_words, rare))
    told, key, changed = marked(docs, marks(gone))
    places, lines = fresh(told, "gone_", "lines_")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed")]
    split = F.split(body(), "\n")
    same = told.where(F.col(changed) == 0).select(*others, body().alias("text"), F.size(split).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    held = told.where(F.col(changed) == 1).join(gone.select(F.col("rid").alias(key), F.col("gone").alias(places)).hint("shuffle_hash"), key).withColumn(lines, split)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places))
    text = F.array_join(F.transform(left, lambda i: F.get(F.col(lines), i)), "\n")
    return same.unionByName(held.select(*others, text.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.size(places).cast("long").alias("n_removed")))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
