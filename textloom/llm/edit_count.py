"""Edit-aware token counts.

A document keeps its pre-tokens in the leaves of a segment tree whose nodes hold sums of characters and of tokens. An
edit finds its place by descending the tree, splits anew only the text that it touches, from two pre-tokens before it to
the first old pre-token boundary behind it at which the new split has one too, counts the tokens of those pre-tokens
and adds the differences up the path to the root. Splitting never looks behind, so from a common boundary on old and
new splits agree; and a pre-token's end never depends on text beyond the next one, so two before the edit are enough.

Leaves are kept: ``leaf_counts`` gives the characters and tokens of each leaf of each document, as arrays that a table
stores, and ``recount`` takes them and a table of edits. It reads only the documents that have edits, restores their
trees from the stored sums without splitting or encoding anything, and encodes the leaves that edits touch.

Defined cases: a null text is the empty text, of no token; a text of any length is counted whole; strings of special
tokens are ordinary text here; rows that repeat count each; null ids are carried along; an empty table gives an empty
result. Edits of a document must not overlap, and are given in code points of the text before all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.llm.bpe import SPLIT, PairIndexBPE, loaded, vocabulary_path
from textloom.llm.common import body, marked, marks, release, rid, slim_batches, stable, table, written
from textloom.llm.pii import emails

#: Pre-tokens in a leaf; texts that a worker splits at once.
LEAF, TEXTS = 32, 1000
_split = regex.compile(SPLIT)


def count_words(bpe: PairIndexBPE, words: list[str]) -> list[int]:
    """Tokens of each pre-token; those met before are remembered."""
    known = bpe.__dict__.setdefault("tokens_of", {})
    if len(known) > 500_000:
        known.clear()
    if new := list({w for w in words if w not in known}):
        known.update(zip(new, (len(x) // 4 for x in bpe.merge_words(new)), strict=True))
    return [known[w] for w in words]


class CountTree:
    """Token count of a text under edits. A leaf is (pre-tokens, their counts), or None until it is touched."""

    def __init__(self, text: str, bpe: PairIndexBPE, words: list[str] | None = None):
        self.bpe, self.encoded, self.source = bpe, 0, ""
        words = _split.findall(text) if words is None else words
        counts = count_words(bpe, words)
        self.leaves = [(words[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(words), LEAF)]
        self._sum([sum(map(len, w)) for w, _ in self.leaves], [sum(c) for _, c in self.leaves])

    @classmethod
    def restored(cls, text: str, chars: np.ndarray, tokens: np.ndarray, bpe: PairIndexBPE) -> CountTree:
        """The tree of a text from its leaves' stored sums; nothing is split or encoded."""
        own = cls("", bpe)
        own.source, own.leaves = text, [None] * len(chars)
        own.first = np.cumsum(chars) - chars  # where each leaf, as yet untouched, starts in the source
        own.sizes = np.asarray(chars)
        own._sum(chars, tokens)
        return own

    def _sum(self, chars, tokens) -> None:
        self.base = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.base, np.int64), np.zeros(2 * self.base, np.int64)
        self.chars[self.base : self.base + len(self.leaves)], self.tokens[self.base : self.base + len(self.leaves)] = chars, tokens
        level = self.base
        while level > 1:
            for x in (self.chars, self.tokens):
                x[level // 2 : level] = x[level : 2 * level].reshape(-1, 2).sum(1)
            level //= 2

    def _split_leaf(self, leaf: int) -> list[str]:
        """The leaf's pre-tokens, split when it is first touched. It starts at a pre-token of the source, and so splits alike."""
        if self.leaves[leaf] is None:
            words, end = [], int(self.first[leaf] + self.sizes[leaf])
            for m in _split.finditer(self.source, int(self.first[leaf])):
                if m.start() >= end:
                    break
                words.append(m.group())
            self.encoded += len(words)
            self.leaves[leaf] = (words, None)
        return self.leaves[leaf][0]

    def _at(self, leaf: int) -> tuple[list[str], list[int]]:
        words = self._split_leaf(leaf)
        if self.leaves[leaf][1] is None:
            self.leaves[leaf] = (words, count_words(self.bpe, words))
        return self.leaves[leaf]

    def near(self, edits: list[tuple[int, int, str]]) -> Iterator[str]:
        """Pre-tokens of the leaves of a restored tree that edits of its source touch, so that many trees' are encoded at once."""
        for start, end, _ in edits:
            low, high = np.searchsorted(self.first, [max(0, start - 1), end], "right") - 1
            for k in range(max(0, int(low) - 1), min(len(self.leaves), int(high) + 2)):
                yield from self._split_leaf(k)

    def _set(self, leaf: int, words: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = (words, counts)
        k = self.base + leaf
        chars, tokens = sum(map(len, words)) - self.chars[k], sum(counts) - self.tokens[k]
        while k:
            self.chars[k] += chars
            self.tokens[k] += tokens
            k //= 2

    def total(self) -> int:
        return int(self.tokens[1])

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of each leaf, to be stored."""
        own = slice(self.base, self.base + len(self.leaves))
        return self.chars[own], self.tokens[own]

    def text(self) -> str:
        return "".join(w for k in range(len(self.leaves)) for w in self._at(k)[0])

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character, or the last one, and where it starts."""
        k, start = 1, 0
        while k < self.base:
            k *= 2
            if at >= start + self.chars[k] and self.chars[k + 1]:
                start += int(self.chars[k])
                k += 1
        return k - self.base, start

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts ``new`` in the place of the characters from start to end."""
        if not self.leaves:
            self.leaves = [([], [])]
            self._sum([0], [0])
        first, begin = self._leaf(max(0, start - 1))
        last, spare = first, start - 1  # leaves at hand; pre-tokens that start before ``spare`` are enough in front
        while first and sum(self._starts(range(first, last + 1), begin) < spare) < 3:
            first -= 1
            begin -= int(self.chars[self.base + first])
        while True:
            own = range(first, last + 1)
            starts = self._starts(own, begin)
            reach = begin + sum(int(self.chars[self.base + k]) for k in own)
            words = [w for k in own for w in self._at(k)[0]]
            counts = [c for k in own for c in self._at(k)[1]]
            whole = last + 1 == len(self.leaves)
            if reach < end or not words and not whole:
                last += 1
                continue
            back = max(0, int(np.searchsorted(starts, max(0, spare), "right")) - 3)
            at = int(starts[back]) if words else begin
            known = "".join(words[back:])
            edited = known[: start - at] + new + known[end - at :]
            shift, made, stop = len(new) - (end - start), [], len(words) if whole else None
            old = {int(p): i for i, p in enumerate(starts)}
            pos = at
            for m in _split.finditer(edited):
                made.append(m.group())
                pos = at + m.end()
                if pos - shift >= end and pos >= start + len(new) and m.end() <= len(edited) - 2 and pos - shift in old:
                    stop = old[pos - shift]
                    break
            if stop is not None:
                break
            last += 1
        self.encoded += len(made)
        self._set(first, words[:back] + made + words[stop:], counts[:back] + count_words(self.bpe, made) + counts[stop:])
        for k in range(first + 1, last + 1):
            self._set(k, [], [])
        if len(self.leaves[first][0]) > 8 * LEAF:
            self._part(first)

    def _part(self, leaf: int) -> None:
        """Cuts a leaf that has grown into several and drops empty ones; all other leaves stay as they are, touched or not."""
        words, counts = self.leaves[leaf]
        pieces = [(words[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(words), LEAF)]
        chars, tokens = self.sums()
        more = [([sum(map(len, w)) for w, _ in pieces], [sum(c) for _, c in pieces]), *[[0] * len(pieces)] * 2]
        first, sizes = (self.first, self.sizes) if self.source else (chars, chars)
        columns = [np.concatenate([x[:leaf], y, x[leaf + 1 :]]) for x, y in zip((chars, tokens, first, sizes), (*more[0], *more[1:]), strict=True)]
        leaves = [*self.leaves[:leaf], *pieces, *self.leaves[leaf + 1 :]]
        held = [k for k, x in enumerate(leaves) if x is None or x[0]]
        self.leaves, (chars, tokens, first, sizes) = [leaves[k] for k in held], (x[held] for x in columns)
        if self.source:
            self.first, self.sizes = first, sizes
        self._sum(chars, tokens)

    def _starts(self, leaves: range, begin: int) -> np.ndarray:
        """Where each pre-token of the leaves starts."""
        sizes = np.array([len(w) for k in leaves for w in self._at(k)[0]], np.int64)
        return begin + np.cumsum(sizes) - sizes


def standard_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits that the query applies, in code points of the text, last first: e-mail addresses are masked and lines that repeat an earlier line
    of the same text are deleted with their line feed."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line and line in seen:
            edits.append((max(0, at - 1), at + len(line), ""))
        else:
            edits += [(at + a, at + b, "[EMAIL]") for a, b in emails(line)]
        seen.add(line)
        at += len(line) + 1
    return edits[::-1]


def leaf_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, chars and tokens (of each leaf, in order) of every row, to be stored for ``recount``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.iloc[at : at + TEXTS]
                split = [_split.findall(text) for text in part["text"]]
                count_words(bpe, list({w for words in split for w in words}))
                trees = [CountTree(text, bpe, words) for text, words in zip(part["text"], split, strict=True)]
                sums = [t.sums() for t in trees]
                yield part.drop(columns="text").assign(n_tokens=[t.total() for t in trees], chars=[x for x, _ in sums], tokens=[x for _, x in sums])
        bpe.__dict__.pop("tokens_of", None)
        release()

    keys, schema = _flat(docs, key)
    slim_batches(docs.sparkSession)
    return _nested(docs.select(*keys, body().alias("text")).mapInPandas(run, f"{schema}, n_tokens long, chars array<int>, tokens array<int>"), key, docs)


def _flat(docs: DataFrame, key: str) -> tuple[list[Column], str]:
    """The key as plain columns, and their schema; a struct goes to Python by its fields."""
    kind = docs.schema[key].dataType
    if isinstance(kind, StructType):
        return [F.col(key)[f.name].alias(f.name) for f in kind], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    return [F.col(key)], f"{key} {kind.simpleString()}"


def _nested(df: DataFrame, key: str, docs: DataFrame) -> DataFrame:
    kind = docs.schema[key].dataType
    if isinstance(kind, StructType):
        names = [f.name for f in kind]
        return df.select(F.struct(*names).alias(key), *[c for c in df.columns if c not in names])
    return df


def recount(docs: DataFrame, leaves: DataFrame, edits: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """key, n_tokens_before, n_edits, n_tokens, n_reencoded (pre-tokens encoded anew), chars, tokens of the rows that have
    edits. docs: key (distinct), text; leaves: what ``leaf_counts`` gave; edits: key, start, end, new."""
    each = edits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "new")), asc=False).alias("edits"))
    asked = each.join(leaves.select(key, "n_tokens", "chars", "tokens"), key).join(docs.select(key, body().alias("text")), key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(vocabulary)
        for batch in batches:
            rows = []
            trees = [CountTree.restored(t, np.asarray(c, np.int64), np.asarray(n, np.int64), bpe) for t, c, n in zip(batch["text"], batch["chars"], batch["tokens"], strict=True)]
            edits = [[(e["start"], e["end"], e["new"]) for e in own] for own in batch["edits"]]
            count_words(bpe, list({w for tree, own in zip(trees, edits, strict=True) for w in tree.near(own)}))
            for tree, own in zip(trees, edits, strict=True):
                for edit in own:  # last first, so that places before stay what they are
                    tree.replace(*edit)
                rows.append((len(own), tree.total(), tree.encoded, *tree.sums()))
            out = pd.DataFrame(rows, columns=["n_edits", "now", "n_reencoded", "chars", "tokens"], index=batch.index)
            yield pd.concat([batch.drop(columns=["edits", "chars", "tokens", "text"]), out], axis=1)
        bpe.__dict__.pop("tokens_of", None)
        release()

    keys, schema = _flat(docs, key)
    slim_batches(docs.sparkSession)
    got = asked.select(*keys, "n_tokens", "edits", "chars", "tokens", "text").mapInPandas(run, f"{schema}, n_tokens long, n_edits long, now long, n_reencoded long, chars array<int>, tokens array<int>")
    return _nested(got.withColumnRenamed("n_tokens", "n_tokens_before").withColumnRenamed("now", "n_tokens"), key, docs)


def standard_edit_table(docs: DataFrame, key: str) -> DataFrame:
    """key, start, end, new of the standard edits of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [standard_edits(t) for t in batch["text"]]
            rows = batch.drop(columns="text").loc[batch.index.repeat([len(x) for x in own])].reset_index(drop=True)
            yield rows.assign(**{c: [e[k] for x in own for e in x] for k, c in enumerate(("start", "end", "new"))})

    keys, schema = _flat(docs, key)
    return _nested(docs.select(*keys, body().alias("text")).mapInPandas(run, f"{schema}, start long, end long, new string"), key, docs)


def edit_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_reencoded of every row under the standard edits: leaves and edits are
    tables, and only texts with edits are read again."""
    docs = stable(docs)
    named = docs.select(rid(docs).alias("rid"), "text")
    leaves = written(leaf_counts(named, vocabulary, "rid"))
    edits = written(standard_edit_table(named, "rid"))
    told, key, changed = marked(docs.select("text"), marks(edits.select("rid").distinct()))
    asked = told.where(F.col(changed) == 1).select(F.col(key).alias("rid"), "text")
    again = written(recount(asked, leaves, edits, vocabulary, "rid").select("rid", "n_edits", F.col("n_tokens").alias("now"), "n_reencoded"))
    ids = docs.select(rid(docs).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"))
    every = ids.join(leaves.select("rid", "n_tokens"), "rid").join(again, "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.select("doc_id", "n_tokens", zero("n_edits"), F.coalesce("now", "n_tokens").alias("n_tokens_edited"), zero("n_reencoded"))


def op8_edit_counts(spark, sf_dir: str) -> DataFrame:
    return edit_counts(table(spark, sf_dir, "documents"), vocabulary_path())
