"""SimHash near duplicates with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, each taken as a word of the perfect binary Golay
code of length 23. A word's keys are the codewords to which it and its 23 neighbours decode, six at most; two words
that differ in up to two bits share one, since a word between them is a neighbour of both. Of four or fewer differing
bits, two segments together have at most two, by the pigeonhole principle, so of the three pairs of segments one has
up to two in either. Each pair of keys of each pair of segments is a bucket; fingerprints that meet in a bucket are
verified, and no link is lost.

Buckets are made over distinct fingerprints. In a bucket a search from seeds removes what it reaches, so a bucket of m
fingerprints gives at most m - 1 links, never all its pairs, and bucket links are thinned to a forest per part.
Buckets above BUCKET fingerprints are cut into blocks and each pair of blocks is a bucket of its own, in its own task.

Near duplicates of word shingles at a similarity of 0.8 differ in some 15 % of the bits, more than 64 bits can find.
``keep_one`` therefore takes two fingerprints of the distinct shingles (128 bits, six segments), buckets by all fifteen
pairs of segments, and takes WIDE_DISTANCE differing bits as a candidate. Candidates, thinned to forests, only tell
which texts are connected; the shingle sets of all texts of a component are then compared exactly, whatever candidates were
thinned out. Components above GROUP bytes are cut into blocks, and each pair of blocks is compared in its own task. Links
are thinned after the comparison: no link below the similarity stands, and none between connected texts is lost. Buckets
connect most texts at the similarity, not all: of 8999 links among 51282 texts (check_s) all but 6. Equal pairs of fingerprints count as equal sets.

Defined cases: a null text is the empty text; texts without a word have fingerprint zero and link like any other;
texts of fewer words than a shingle are one shingle; rows that repeat share a fingerprint; null ids are carried along
and never smallest (a component of null ids alone has a null component_id); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import batches_of, body, kept, marked, marks, release, rid, small, stable, table, written
from textloom.llm.components import components

SEED, DISTANCE, SEGMENTS = 42, 4, ((0, 22), (22, 21), (43, 21))
#: A second fingerprint's seed; differing bits of 128 up to which shingle sets may have the similarity.
MORE_SEED, WIDE_DISTANCE = 43, 28
SIMILARITY = 0.8
#: Fingerprints of one bucket that one task compares; keys of one part, about; fingerprints whose keys are made at once.
BUCKET, PART, ROWS = 20_000, 600_000, 6000
#: Classes of a segment's keys by which several fingerprints are dealt, at least.
CLASSES = 4
#: Bytes of shingle sets that one task compares; of texts that a worker holds at once.
GROUP, BATCH = 16 << 20, "6m"


def shingles_of(text: str, words: int) -> list[bytes]:
    """Runs of so many words of the whole text, repeats included; of a text of fewer words the whole sequence, if any."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    whole, n = b" ".join(tokens), len(tokens)
    if n <= words:
        return [whole] if n else []
    sizes = np.fromiter(map(len, tokens), np.int64, n) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    return [whole[a:b] for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def shingle_set(text: str, words: int) -> bytes:
    """The distinct shingles as sorted hashes of 32 bits."""
    return np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) & 0xFFFFFFFF for x in shingles_of(text, words)], "<u4")).tobytes()


def fingerprint(text: str, words: int, seeds: tuple[int, ...] = (SEED,), distinct: bool = False) -> list[int]:
    """Of each seed, the bits that are set in over half the hashes of the text's shingles; whole text, repeats included
    unless ``distinct``."""
    shingles, digest = shingles_of(text, words), xxhash.xxh64_intdigest
    if not shingles:
        return [0] * len(seeds)
    if distinct:
        shingles = list(set(shingles))
    out = []
    for seed in seeds:
        hashes, counts = np.array([digest(x, seed) for x in shingles], "<u8"), np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, words: int = 4, seeds: tuple[int, ...] = (SEED,), distinct: bool = False) -> DataFrame:
    """rid, doc_id, node, fp (fingerprints as signed longs) of every row of a stable table.

    node names the fingerprints as one long: the fingerprint itself, or a mix of two.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(t, words, seeds, distinct) for t in batch["text"]], np.uint64).reshape(-1, len(seeds))
            yield pd.DataFrame({"file": batch["file"], "row": batch["row"], "doc_id": batch["doc_id"], "node": nodes_of(prints).view(np.int64), "fp": list(prints.view(np.int64))})
        release()

    source = docs.select(rid(docs).alias("rid"), F.col("doc_id").cast("long"), body().alias("text")).select("rid.file", "rid.row", "doc_id", "text")
    out = source.mapInPandas(run, "file long, row long, doc_id long, node long, fp array<long>")
    return out.select(F.struct("file", "row").alias("rid"), "doc_id", "node", "fp")


def nodes_of(prints: np.ndarray) -> np.ndarray:
    node = prints[:, 0].copy()
    for k in range(1, prints.shape[1]):
        node = (node ^ node >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + prints[:, k]
    return node


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the 23 unit words; the leader of each syndrome's coset; tables of syndromes by byte.

    The generator polynomial is x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1; all patterns of up to three errors have
    different syndromes and are all the leaders.
    """
    unit = np.zeros(23, np.int64)
    for i in range(23):
        word = 1 << i
        for top in range(22, 10, -1):
            if word >> top & 1:
                word ^= 0b110001110101 << (top - 11)
        unit[i] = word
    leader = np.zeros(2048, np.int64)
    for errors in range(1, 4):
        for places in combinations(range(23), errors):
            leader[np.bitwise_xor.reduce(unit[list(places)])] = sum(1 << p for p in places)
    by_byte = np.zeros((3, 256), np.int64)
    for k in range(3):
        for bit in range(8):
            if 8 * k + bit < 23:
                by_byte[k] ^= np.where(np.arange(256) >> bit & 1, unit[8 * k + bit], 0)
    return unit, leader, by_byte


def codeword_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 24) indices of the codewords to which each word and its neighbours decode, sorted, and which are new in their row."""
    unit, leader, by_byte = golay()
    words = words.astype(np.int64)
    syndrome = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]
    flips = np.r_[0, 1 << np.arange(23)]
    codes = words[:, None] ^ flips ^ leader[syndrome[:, None] ^ np.r_[0, unit]]
    keys = np.sort(codes >> 11, axis=1)  # the code is systematic: the upper 12 bits name the codeword
    return keys, np.c_[np.ones(len(keys), bool), keys[:, 1:] != keys[:, :-1]]


def segment_pairs(k: int) -> list[tuple[int, int]]:
    """All pairs of the segments of k fingerprints."""
    return list(combinations(range(3 * k), 2))


def segment_keys(prints: np.ndarray, segment: int) -> np.ndarray:
    """Of every row of fingerprints (n, k) of uint64 the segment's keys, -1 where it has fewer than others."""
    shift, bits = SEGMENTS[segment % 3]
    keys, new = codeword_keys(prints[:, segment // 3] >> np.uint64(shift) & np.uint64((1 << bits) - 1))
    n = new.sum(1)
    held = np.full((len(prints), int(n.max()) if len(n) else 1), -1, np.int64)
    rows, _ = np.nonzero(new)
    held[rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)] = keys[new]
    return held


def pair_keys(pair: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every bucket that a pair of segments with these keys makes."""
    rows, x, y = np.nonzero((a[:, :, None] >= 0) & (b[:, None, :] >= 0))
    return (pair << 24) | (a[rows, x] << 12) | b[rows, y], rows


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place in prints) of every bucket of every row of fingerprints (n, k) of uint64."""
    own = [segment_keys(prints, at) for at in range(3 * prints.shape[1])]
    found = [pair_keys(pair, own[i], own[j]) for pair, (i, j) in enumerate(segment_pairs(prints.shape[1]))]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def cells(prints: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, place in prints), each once: a pair of segments and the classes, modulo g, of a key of either."""

    def classes(held: np.ndarray) -> np.ndarray:
        out = np.zeros((len(held), g + 1), bool)
        np.put_along_axis(out, np.where(held < 0, g, held % g), True, axis=1)
        return out[:, :g]

    own, cell, places = [classes(segment_keys(prints, at)) for at in range(3 * prints.shape[1])], [], []
    for pair, (i, j) in enumerate(segment_pairs(prints.shape[1])):
        rows, x, y = np.nonzero(own[i][:, :, None] & own[j][:, None, :])
        cell.append((pair * g + x) * g + y)
        places.append(rows)
    return np.concatenate(cell), np.concatenate(places)


def cell_keys(prints: np.ndarray, cell: int, g: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place in prints) of the buckets of one cell."""
    pair, x, y = cell // g // g, cell // g % g, cell % g
    i, j = segment_pairs(prints.shape[1])[pair]
    found = []
    for at in range(0, max(1, len(prints)), ROWS):
        a, b = (segment_keys(prints[at : at + ROWS], n) for n in (i, j))
        buckets, rows = pair_keys(pair, np.where(a % g == x, a, -1), np.where(b % g == y, b, -1))
        found.append((buckets, rows + at))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def run_links(own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs within the distance join, at most one fewer than there are fingerprints."""
    left, u, v = own, [own[:0]], [own[:0]]
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            seed = frontier.pop()
            near = differing(left, seed) <= distance
            if near.any():
                found, left = left[near], left[~near]
                u.append(np.repeat(seed[None], len(found), 0))
                v.append(found)
                frontier += list(found)
    return np.concatenate(u), np.concatenate(v)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the links but the roots; the root is the smallest node as uint64."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if (label == before).all():
            break
    hung = label != np.arange(len(nodes))
    return nodes[hung], nodes[label[hung]]


def nearest_links(own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of least distances over the fingerprints, of links within the distance."""
    left, near = own[1:].copy(), own[1:].copy()
    best, last, u, v = np.full(len(left), 1 << 30), own[0], [own[:0]], [own[:0]]
    while len(left):
        d = differing(left, last)
        closer = d < best
        best[closer], near[closer] = d[closer], last
        at = int(best.argmin())
        last = left[at].copy()
        if best[at] <= distance:
            u.append(near[at : at + 1].copy())
            v.append(last[None])
        for x in (left, near, best):
            x[at] = x[-1]
        left, near, best = left[:-1], near[:-1], best[:-1]
    return np.concatenate(u), np.concatenate(v)


def nearest_forest(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between nodes, those of a spanning forest of least distances d: each tree takes its nearest link to another."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    rank = np.empty(len(u), np.int64)
    order = np.lexsort((v, u, d))
    rank[order] = np.arange(len(u))
    label, taken = np.arange(len(nodes)), [order[:0]]
    while (apart := label[a] != label[b]).any():
        best = np.full(len(nodes), len(u))
        for side in (a, b):
            np.minimum.at(best, label[side[apart]], rank[apart])
        new = order[np.unique(best[best < len(u)])]
        taken.append(new)
        x, y = label[a[new]], label[b[new]]
        own = np.arange(len(nodes))
        while (own[x] != own[y]).any():
            least = np.minimum(own[x], own[y])
            np.minimum.at(own, x, least)
            np.minimum.at(own, y, least)
            own = own[own]
        label = own[label]
    chosen = np.concatenate(taken)
    return u[chosen], v[chosen]


def bucket_links(buckets: np.ndarray, prints: np.ndarray, distance: int, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A forest, as nodes, of the links within the buckets; with ``nearest`` each is a pair within the distance, and they
    are the nearest ones. prints: (n, k)."""
    order = np.argsort(buckets, kind="stable")
    buckets, prints = buckets[order], prints[order]
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    sizes = np.diff(np.r_[starts, len(buckets)])
    u, v = [prints[:0]], [prints[:0]]
    for at in np.flatnonzero(sizes > 32):
        a, b = (nearest_links if nearest else run_links)(prints[starts[at] : starts[at] + sizes[at]], distance)
        u.append(a)
        v.append(b)
    little = np.repeat(sizes <= 32, sizes)
    buckets, prints = buckets[little], prints[little]
    for step in range(1, min(32, len(buckets))):
        same = buckets[step:] == buckets[:-step]
        if not same.any():
            break
        a, b = prints[:-step][same], prints[step:][same]
        near = differing(a, b) <= distance
        u.append(a[near])
        v.append(b[near])
    u, v = np.concatenate(u), np.concatenate(v)
    d, u, v = differing(u, v), nodes_of(u), nodes_of(v)
    if nearest:
        return nearest_forest(np.minimum(u, v), np.maximum(u, v), d)
    return forest(u, v) if len(u) else (u, v)


def links(prints: DataFrame, distance: int = DISTANCE, k: int = 1, nearest: bool = False) -> DataFrame:
    """Links (u, v) of nodes over distinct fingerprints (column fp, k of them); for k = 1 and a distance of up to 4 they
    join exactly what all pairs within the distance join. With ``nearest`` each is a pair within the distance."""
    n = prints.count()
    parts = max(8, math.ceil(n * 28 * len(segment_pairs(k)) / PART))
    # Of several fingerprints the parts are cells, which get a row once and make its keys again; hot buckets' blocks come after.
    classes = max(CLASSES, math.ceil(math.sqrt(n * 28 / PART))) if k > 1 else 0
    first = len(segment_pairs(k)) * classes**2

    def held(batch: pd.DataFrame, at: int) -> np.ndarray:
        return np.array(batch["fp"].iloc[at : at + ROWS].tolist(), np.int64).reshape(-1, k).view(np.uint64)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                buckets, n = np.unique(bucket_keys(held(batch, at))[0], return_counts=True)
                yield pd.DataFrame({"bucket": buckets, "n": n * every})
        release()

    # Which buckets are to be cut is told by a part of the fingerprints, chosen by hash; it decides on tasks, not on links.
    every = max(1, BUCKET // 300)
    part_of = prints.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp")
    told = part_of.mapInPandas(tell, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > BUCKET)
    # The largest, as many as a driver holds; a bucket beyond them is one task's.
    hot = {r[0]: -(-r[1] // BUCKET) for r in told.orderBy(F.desc("n"), "bucket").limit(100_000).collect()}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                own = held(batch, at)
                buckets, places = bucket_keys(own) if hot or k == 1 else (np.empty(0, np.int64), np.empty(0, np.int64))
                mine = own[places]
                if hot:
                    heated = np.isin(buckets, np.fromiter(hot, np.int64, len(hot)))
                    more_b, more_p = ([buckets[~heated]], [mine[~heated]]) if k == 1 else ([buckets[:0]], [mine[:0]])
                    for bucket in np.unique(buckets[heated]).tolist():
                        inside, g = mine[buckets == bucket], hot[bucket]
                        block = (nodes_of(inside) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % g
                        for other in range(g):
                            more_b.append((bucket << 32) | (1 << 61) | (np.minimum(block, other) << 16) | np.maximum(block, other))
                            more_p.append(inside)
                    buckets, mine = np.concatenate(more_b), np.concatenate(more_p)
                if len(buckets):
                    part = (buckets.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts + first
                    order = np.argsort(part, kind="stable")
                    part, buckets, mine = part[order], buckets[order], mine[order]
                    ks, cuts = np.unique(part, return_index=True)
                    yield pd.DataFrame([(int(p), b.tobytes(), h.tobytes()) for p, b, h in zip(ks, np.split(buckets, cuts[1:]), np.split(mine, cuts[1:]), strict=True)], columns=["part", "buckets", "prints"])
                if k > 1:
                    part, places = cells(own, classes)
                    order = np.argsort(part, kind="stable")
                    ks, cuts = np.unique(part[order], return_index=True)
                    yield pd.DataFrame([(int(p), b"", own[x].tobytes()) for p, x in zip(ks, np.split(places[order], cuts[1:]), strict=True)], columns=["part", "buckets", "prints"])
        release()

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        buckets, own = np.frombuffer(b"".join(group["buckets"]), np.int64), np.frombuffer(b"".join(group["prints"]), np.uint64).reshape(-1, k)
        if group["part"].iloc[0] < first:
            buckets, places = cell_keys(own, int(group["part"].iloc[0]), classes)
            cold = ~np.isin(buckets, np.fromiter(hot, np.int64, len(hot)))
            buckets, own = buckets[cold], own[places[cold]]
        u, v = bucket_links(buckets, own, distance, nearest)
        release()
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = prints.select("fp").mapInPandas(deal, "part long, buckets binary, prints binary")
    return dealt.groupBy("part").applyInPandas(compare, "u long, v long")


def set_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in sets) that join what all pairs with the similarity join, at most one fewer than there are sets.

    A seed is compared with all sets at once, by the holders of each of its hashes; what it reaches is taken out.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), sizes)[np.argsort(token, kind="stable")]
    held = np.bincount(token)
    first = np.cumsum(held) - held
    left, u, v = np.ones(len(sets), bool), [ends[:0]], [ends[:0]]
    for start in range(len(sets)):
        frontier = [start] if left[start] else []
        left[start] = False
        while frontier and left.any():
            seed = frontier.pop()
            own = token[ends[seed] - sizes[seed] : ends[seed]]
            n = held[own]
            at = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(holder[at], minlength=len(sets))
            union = sizes + sizes[seed] - both
            found = np.flatnonzero(left & ((both / np.maximum(union, 1) >= similarity) | (union == 0)))
            left[found] = False
            u.append(np.full(len(found), seed))
            v.append(found)
            frontier += found.tolist()
    return np.concatenate(u), np.concatenate(v)


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (u, v) that join what all pairs with the similarity join, of texts that the candidates (u, v) connect.
    nodes: node, first.rid (a row with that text)."""
    asked = written(components(pairs).join(nodes, "node").select("node", "root", F.col("first.rid").alias("rid")))
    told, key, wanted = marked(docs, marks(asked))
    texts = told.where(F.col(wanted) == 1).select(F.col(key)["file"].alias("file"), F.col(key)["row"].alias("row"), body().alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file": batch["file"], "row": batch["row"], "own": [shingle_set(t, words) for t in batch["text"]]})
        release()

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        u, v = set_links([np.frombuffer(x, "<u4") for x in group["own"]], similarity)
        node = group["node"].to_numpy()
        return pd.DataFrame({"u": node[u], "v": node[v]})

    with batches_of(docs.sparkSession, BATCH):
        held = texts.mapInPandas(cut, "file long, row long, own binary").select(F.struct("file", "row").alias("rid"), "own")
        sets = written(held.join(small(asked), "rid").select("node", "root", "own"))
    # A component above the limit is cut into blocks of half of it; each pair of blocks is a group.
    many = sets.groupBy("root").agg(F.sum(F.length("own")).alias("size")).where(F.col("size") > GROUP).select("root", F.ceil(2 * F.col("size") / GROUP).cast("int").alias("g"))
    dealt = sets.join(small(written(many)), "root", "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("x", F.pmod(F.xxhash64("node"), "g").cast("int"))
    dealt = dealt.withColumn("y", F.explode(F.expr("filter(sequence(0, g - 1), o -> o <> x or g = 1)")))
    return dealt.groupBy("root", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = DISTANCE, seeds: tuple[int, ...] = (SEED,), similarity: float | None = None) -> DataFrame:
    """One row per row of docs: rid, doc_id, fp (array<long>), component_id, kept (of each component the smallest id's first row).

    With a similarity, fingerprints are of distinct shingles, and links are pairs whose sets of shingles have it, among
    texts that pairs within the distance connect.
    """
    exact = similarity is not None
    docs = stable(docs)
    with batches_of(docs.sparkSession, BATCH):
        prints = written(fingerprints(docs, words, seeds, exact))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    distinct = written(prints.groupBy("node", "fp").agg(first))
    found = links(distinct, distance, len(seeds), exact)
    if exact:
        found = alike(found, distinct, docs, words, similarity)
    joined = written(components(found)).withColumnRenamed("node", "of")
    rooted = distinct.join(joined, distinct.node == joined.of, "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    whole = written(rooted.join(rooted.groupBy("root").agg(F.min("first").alias("best")), "root").select("node", "best"))
    return prints.join(small(whole), "node").select("rid", "doc_id", "fp", F.col("best.doc_id").alias("component_id"), (F.col("rid") == F.col("best.rid")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, distance: int = WIDE_DISTANCE, seeds: tuple[int, ...] = (SEED, MORE_SEED)) -> DataFrame:
    """One row of each group of near duplicates, with docs' columns."""
    docs = stable(docs)
    return kept(docs, near_duplicates(docs, words, distance, seeds, similarity).where(~F.col("kept")).select("rid"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")
