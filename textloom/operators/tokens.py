"""Byte-level BPE: frequencies in Spark, merges learnt on the driver from distinct pre-tokens, encoding by distinct pre-token."""

from __future__ import annotations

import hashlib
import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.sources.tables import slim_batches

# Special tokens, and how much of each lane the merges are learnt from.
SPECIALS, PER_LANE, SAMPLE_CHARS = ("<pad>", "<bos>", "<eos>", "<unk>"), 300, 2000
#: Pre-tokens whose numbers a worker keeps, and how many characters one of them may have; others are merged each time.
KNOWN, KNOWN_CHARS = 500_000, 64


def byte_symbols() -> list[str]:
    """A printable symbol for each byte: its own character if printable, else the next one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


SYMBOLS = byte_symbols()
BYTES = {s: b for b, s in enumerate(SYMBOLS)}


def to_symbols(text: str) -> list[str]:
    return [SYMBOLS[b] for b in text.encode("utf-8")]


def from_symbols(symbols: str) -> str:
    return bytes(BYTES[s] for s in symbols).decode("utf-8")


def lane_sample(docs: DataFrame, per_lane: int = PER_LANE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """The first documents of each lane, cut to a length; ranks above the bound are dropped before the shuffle."""
    place = F.row_number().over(Window.partitionBy("lane").orderBy("pos"))
    return docs.select("id", "pos", "lane", F.substring("text", 1, chars).alias("text")).withColumn("n", place).where(F.col("n") <= per_lane).drop("n")


def pretoken_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(X.pretokens(F.col("text"))).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("n"))


def char_pairs(docs: DataFrame) -> DataFrame:
    """Neighbouring characters within pre-tokens, weighted by how often the pre-token comes."""
    pairs = F.expr("transform(sequence(1, length(pretoken) - 1), i -> substring(pretoken, i, 2))")
    return pretoken_counts(docs).where(F.length("pretoken") > 1).select(F.explode(pairs).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))


def learn_merges(counts: dict[str, int], vocab_size: int, specials=SPECIALS) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """(vocabulary, merges) from pre-token counts: the commonest pair each time, ties to the smaller pair.

    Pairs are kept with the words that hold them, so that a merge revisits only those, and wait in a heap by count; a pair
    whose merged token exists already is set aside unless its count changes.
    """
    vocab: dict[str, int] = {}
    for t in (*specials, *SYMBOLS):
        vocab.setdefault(t, len(vocab))
    words = [(to_symbols(w), n) for w, n in sorted(counts.items())]
    weight: Counter = Counter()
    holders: dict[tuple[str, str], set[int]] = defaultdict(set)
    for k, (w, n) in enumerate(words):
        for p in zip(w, w[1:], strict=False):
            weight[p] += n
            holders[p].add(k)
    queue = [(-n, p) for p, n in weight.items()]  # an entry whose weight isn't the pair's any more is skipped
    heapify(queue)
    merges: list[tuple[str, str]] = []
    while queue and len(vocab) < vocab_size:
        n, (a, b) = heappop(queue)
        if n == 0 or -n != weight[a, b]:
            continue
        if a + b in vocab:
            weight[a, b] = 0
            continue
        changed = set()
        for k in holders.pop((a, b)):
            old, times = words[k]
            new, at = [], 0
            while at < len(old):
                step = 2 if old[at : at + 2] == [a, b] else 1
                new.append("".join(old[at : at + step]))
                at += step
            if len(new) == len(old):
                continue
            for p in zip(old, old[1:], strict=False):
                weight[p] -= times
                changed.add(p)
            for p in zip(new, new[1:], strict=False):
                weight[p] += times
                holders[p].add(k)
                changed.add(p)
            words[k] = (new, times)
        weight[a, b] = 0
        for p in changed:
            if weight[p] > 0:
                heappush(queue, (-weight[p], p))
            else:
                holders.pop(p, None)
        vocab[a + b] = len(vocab)
        merges.append((a, b))
    return vocab, merges


def train(docs: DataFrame, vocab_size: int) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Learns from a bounded sample of each lane; only its distinct pre-tokens reach the driver."""
    return learn_merges({r[0]: r[1] for r in pretoken_counts(lane_sample(docs)).toLocalIterator()}, vocab_size)


def merge_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The word's symbols after all merges: the lowest rank first, of several places the leftmost. Places wait in a heap by
    rank, so a long run without white space costs little more than in proportion to its length."""
    own = to_symbols(word)
    after, before = [*range(1, len(own)), -1], list(range(-1, len(own) - 1))
    queue = [(ranks[p], k, *p) for k, p in enumerate(zip(own, own[1:], strict=False)) if p in ranks]
    heapify(queue)
    while queue:
        _, k, a, b = heappop(queue)
        j = after[k]
        if own[k] != a or j < 0 or own[j] != b:
            continue
        own[k], own[j] = a + b, ""
        after[k] = after[j]
        if after[j] >= 0:
            before[after[j]] = k
        for left, right in ((before[k], k), (k, after[k])):
            if left >= 0 and right >= 0 and (p := (own[left], own[right])) in ranks:
                heappush(queue, (ranks[p], left, *p))
    return [x for x in own if x]


def encode(docs: DataFrame, vocab: dict[str, int], merges: list[tuple[str, str]]) -> DataFrame:
    """id, tokens (array<int>) of every document; a worker merges each distinct pre-token once, as long as it keeps it."""
    slim_batches(docs.sparkSession)
    ranks = {m: k for k, m in enumerate(merges)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            out = []
            for own in batch["pretokens"]:
                ids: list[int] = []
                for w in own:
                    own_ids = known.get(w)
                    if own_ids is None:
                        own_ids = [vocab[t] for t in merge_word(w, ranks)]
                        if len(w) <= KNOWN_CHARS:
                            if len(known) >= KNOWN:
                                known.clear()
                            known[w] = own_ids
                    ids += own_ids
                out.append(np.array(ids, np.int32))
            yield pd.DataFrame({"id": batch["id"], "tokens": out})

    return docs.select("id", X.pretokens(F.col("text")).alias("pretokens")).mapInPandas(run, "id string, tokens array<int>")


def decode(tokens: DataFrame, vocab: dict[str, int], specials=SPECIALS) -> DataFrame:
    """id, text; special tokens are skipped, an unknown number is an error."""
    slim_batches(tokens.sparkSession)
    names = {i: t for t, i in vocab.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "text": [from_symbols("".join(names[i] for i in own if names[i] not in specials)) for own in batch["tokens"]]})

    return tokens.select("id", "tokens").mapInPandas(run, "id string, text string")


def integrity(vocab: dict[str, int], merges: list[tuple[str, str]], specials=SPECIALS) -> list[str]:
    """What is wrong with a tokenizer; empty if nothing is."""
    made = {a + b for a, b in merges}
    found = [] if sorted(vocab.values()) == list(range(len(vocab))) else ["ids aren't contiguous"]
    found += [f"byte symbol {s!r} is missing" for s in SYMBOLS if s not in vocab]
    found += [f"merge {m} isn't closed" for m in merges if not {m[0], m[1], m[0] + m[1]} <= vocab.keys()]
    return found + [f"special token {s} is a merge" for s in specials if s in made]


def tokenizer_hash(vocab: dict[str, int], merges: list[tuple[str, str]], specials=SPECIALS) -> str:
    canonical = json.dumps({"merges": [list(m) for m in merges], "specials": list(specials), "vocab": vocab}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(canonical.encode()).hexdigest()


def save(folder: str, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "tokenizer.json").write_text(json.dumps({"vocab": vocab, "merges": merges, "hash": tokenizer_hash(vocab, merges)}, ensure_ascii=False), encoding="utf-8")


def load(folder: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    spec = json.loads(Path(folder, "tokenizer.json").read_text(encoding="utf-8"))
    vocab, merges = spec["vocab"], [tuple(m) for m in spec["merges"]]
    if integrity(vocab, merges) or tokenizer_hash(vocab, merges) != spec["hash"]:
        raise ValueError("the tokenizer was changed")
    return vocab, merges
