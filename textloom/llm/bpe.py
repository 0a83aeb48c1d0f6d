"""BPE encoding and decoding with a pair occurrence index.

The pre-tokens that a partition has not met yet are laid end to end as byte symbols. An index maps each pair that has
a rank to all its positions; ranks are applied in ascending order, each to all its positions at once, and the pairs
that a merge makes go to the lists of their own ranks. A merge can only make pairs of higher rank (checked when the
vocabulary is read), so one pass over the ranks gives what merging word by word gives.

Defined cases: a null text is the empty text and has no ids; the string of a special token in a text becomes that
token; texts of any length are encoded whole; an empty table gives an empty result; only the columns named are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import count, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import body, release, slim_batches, table

#: Fixed value: how byte-level vocabularies of this kind part text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOUCHING = re.compile(r" \s|\s ").search
#: Distinct pre-tokens remembered by a worker before it forgets them all.
REMEMBERED = 300_000
#: Texts, and about how many characters, whose new pre-tokens are indexed at once.
TEXTS, CHARACTERS = 1500, 2_000_000


def symbols_of_bytes() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself if printable, else one from 256 on in turn."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def distinct(at: np.ndarray) -> np.ndarray:
    at = np.sort(at)
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    shift = starts - (np.cumsum(sizes) - sizes)
    return np.repeat(shift, sizes) + np.arange(sizes.sum())


class PairIndexBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        shown = symbols_of_bytes()
        back = {s: b for b, s in enumerate(shown)}
        self.byte_ids = np.array([vocab[s] for s in shown], np.int64)
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.bytes_at = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        made_at = np.full(max(self.bytes_of) + 1, -1)
        made_at[self.made[::-1]] = np.arange(len(merges))[::-1]
        ranks = np.arange(len(merges))
        if len(np.unique(self.made)) < len(merges) or (made_at[self.left] >= ranks).any() or (made_at[self.right] >= ranks).any():
            raise ValueError("a merge makes a pair of lower rank; ranks can't be applied in one ascending pass")
        pairs = (self.left << 32) | self.right
        self.rank_of = np.argsort(pairs)
        self.pairs = pairs[self.rank_of]
        self.split = regex.compile(SPLIT).findall
        self.parts = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.forget()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it has none."""
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.rank_of[at], -1)

    def merge_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, by one pair occurrence index over all of them."""
        if not words:
            return []
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(b) for b in raw])
        sym = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes) - 1
        nxt[ends] = -1
        prv[ends - sizes + 1] = -1
        alive = np.ones(n, bool)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []  # ranks that have places, as a heap

        def index(at: np.ndarray) -> None:
            found = self.ranks(sym[at], sym[nxt[at]])
            at, found = at[found >= 0], found[found >= 0]
            if len(at):
                order = np.argsort(found, kind="stable")
                at, found = at[order], found[order]
                cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
                for rank, where in zip(found[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                    if rank in lists:
                        lists[rank].append(where)
                    else:
                        lists[rank] = [where]
                        heappush(active, rank)

        index(np.flatnonzero(nxt >= 0))
        while active:  # lists fill at higher ranks only
            rank = heappop(active)
            own = lists.pop(rank)
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            at = distinct(np.concatenate(own)) if len(own) > 1 else own[0]
            at = at[alive[at] & (sym[at] == a)]
            at = at[nxt[at] >= 0]
            at = at[sym[nxt[at]] == b]
            if a == b and len(at) > 1:  # of a chain of overlapping places, every second one from the left
                at = np.sort(at)
                starts = np.r_[True, at[1:] != nxt[at[:-1]]]
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], alive[gone], nxt[at] = new, False, after
            linked = after >= 0
            prv[after[linked]] = at[linked]
            before = prv[at]
            index(distinct(np.concatenate([at[linked], before[before >= 0]])))
        ids = sym[alive].astype("<u4").tobytes()
        stops = (np.cumsum(np.add.reduceat(alive, ends - sizes + 1, dtype=np.int64)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def forget(self) -> None:
        """Forgets the pre-token groups met so far. A group's number is its place in starts, sizes; its ids lie in flat."""
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.flat, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def groups(self, text: str) -> list[int]:
        """The numbers of the groups that make up the text.

        Where no space touches other white space, every space starts a pre-token, so what lies between two spaces is
        split the same alone as in the text; such a group is known by itself, without its space. All others are
        known by a line feed, with which no such group starts, and their text.
        """
        number = self.numbers.__getitem__
        pieces = [x for x in self.parts.split(text) if x] if self.parts and any(s in text for s in self.special) else [text]
        out: list[int] = []
        for piece in pieces:
            if piece in self.special:
                out.append(number("\n" + piece))
            elif piece.endswith(" ") or TOUCHING(piece):
                out += [number("\n" + x) for x in self.split(piece)]
            else:
                first, *rest = piece.split(" ")
                if first:
                    out.append(number("\n" + first))
                out += map(number, rest)
        return out

    def learn(self, keys: list[str]) -> None:
        """Gets the ids of the groups, which are numbered in this order, by one pair occurrence index over their pre-tokens."""
        words: dict[str, int] = defaultdict(count().__next__)
        own, sizes = [], []
        for key in keys:
            if key[0] != "\n":
                inside = self.split(" " + key)
            elif key[1:] in self.special:
                inside = [key]
            else:
                inside = self.split(key[1:])
            own += map(words.__getitem__, inside)
            sizes.append(len(inside))
        special = {"\n" + x: i.to_bytes(4, "little") for x, i in self.special.items()}
        plain = [w for w in words if w not in special]
        got = dict(zip(plain, self.merge_words(plain), strict=True))
        ids = [special.get(w) or got[w] for w in words]
        lengths = np.array([len(x) // 4 for x in ids])
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lengths) - lengths
        own = np.array(own)
        per_key = np.add.reduceat(lengths[own], np.cumsum(sizes) - sizes)
        base = len(self.flat)
        self.flat = np.concatenate([self.flat, flat[spread(starts[own], lengths[own])]])
        self.starts = np.concatenate([self.starts, base + np.cumsum(per_key) - per_key])
        self.sizes = np.concatenate([self.sizes, per_key])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, as little-endian unsigned 32-bit integers."""
        out, own, size = [], [], 0
        for text in texts:
            own.append(text)
            size += len(text)
            if len(own) >= TEXTS or size >= CHARACTERS:
                out += self._encode(own)
                own, size = [], 0
        return out + self._encode(own)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.numbers) > REMEMBERED:
            self.forget()
        numbered = [np.array(self.groups(t), np.int32) for t in texts]
        if new := list(islice(self.numbers, len(self.sizes), None)):
            self.learn(new)
        out = []
        for own in numbered:
            out.append(self.flat[spread(self.starts[own], self.sizes[own])].tobytes())
        return out

    def decode(self, ids: bytes) -> str:
        """The text of the ids; special tokens are kept, bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_at.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(1)
def loaded(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def encode(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array<int>) if they are to be kept."""
    hexed = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(vocabulary)
        for batch in batches:
            for start in range(0, len(batch), TEXTS):
                part = batch.iloc[start : start + TEXTS]
                ids = bpe.encode(part["text"].tolist())
                out = {"doc_id": part["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": map(hexed, ids), "decoded_sha256": [hexed(bpe.decode(x).encode("utf-8", "surrogatepass")) for x in ids]}
                out |= {"ids": [np.frombuffer(x, "<i4") for x in ids]} if keep_ids else {}
                yield pd.DataFrame({k: v if isinstance(v, pd.Series) else pd.Series(list(v), index=part.index, dtype=object if k != "n_tokens" else "int64") for k, v in out.items()})
        bpe.forget()
        release()

    # A worker holds a batch of texts beside its groups, so batches are to be small.
    slim_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInPandas(run, schema)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), vocabulary_path())
