"""N-gram Jaccard self-join with signature trees, and the components of its links.

Documents are sets of hashed word n-grams; documents with equal sets are one node. A tree
of signatures stands over all nodes. Its root parts them to clusters by exact keys, so that
every link lies within a cluster. From a limit of ``BY_PARTS`` on, the hashes of a class of
size are parted into more ranges than two linked sets can differ by n-grams, so both have
some range in common as a whole, and the sums of their ranges are the keys: several n-grams
each, which unrelated documents hardly ever share, however many there are. Below it, keys
are n-grams: under one order of all, linked sets share at least r of the first p + r - 1,
where p is how many a set can lack of a partner and one more. A node that shares fewer of
these with any other of like size has no partner and is dropped, which most are; of the
others all but the r - 1 most frequent of what they share tie nodes to clusters.

Below, a cluster's nodes lie in order of size and least n-gram. A leaf
has ``LEAF`` of them, in twigs of a ``FAN``-th each, and ``FAN`` nodes of a level share a parent. Each holds the OR of its sets' bitmaps, the range
of their sizes, the least number of bits of a set and the range of their components. The
levels are tables. Two trees are traversed together from the roots, a level in a join: a
pair of nodes is cut off if the bitmaps leave less overlap than the sizes ask for, or if
all below both are connected. Sets of leaves that are left face to face are compared, again
with bitmaps first, in trees of their own; n-grams are read for these only.

So that copies are never paired with each other in full, each leaf is joined with itself
and with a few pivots of its cluster first, which mostly leaves one main part. Only what is
outside it then visits the leaves that the traversal left, if its own bitmap allows a twig.
A leaf's visitors come in blocks of about ``LEAF``, however many they are. Thus every link
between different components is tested.

Defined cases: null and empty texts, and texts without words, have empty sets, which are
linked with nothing; a text of fewer words than an n-gram has one n-gram, the whole; a text
of any length is taken whole; sets at the limit exactly are linked; repeated rows have
equal sets; a null doc_id is its component only if no member has an id; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emrecon.llm.common import BROADCAST_IDS, TAGS, attach, buckets_for, cut, documents, held, only_marked, ranked, tags
from emrecon.llm.components import connected
from emrecon.sources.scratch import forget

#: Sets that are joined with each other at once, and nodes below a node of the levels above.
LEAF, FAN = 64, 8
#: How much longer than need be a prefix is: half of what a set can lack of a partner, or a
#: third of the set while that is few n-grams, so that a line in common is not enough.
HALF, THIRD, FEW = 2, 3, 16
#: Limit in percent from which sets are tied by ranges of hashes. Below, ranges would hold too few n-grams.
BY_PARTS = 90
#: Largest size of a class over its smallest; n-grams of a range that is no key of its own;
#: ranges for one that may be such.
RATIO, WEAK, SPARE = 1.5, 1, 10
#: Single numbers that are broadcast at once at most to find their rows.
BROADCAST_KEYS = 4_000_000
#: Nodes that a task joins at once, in whole clusters.
BLOCK = 512
#: Members of a cluster that all its leaves are compared with.
PIVOTS = 4
#: Words whose hashes a worker keeps at most; then it starts anew.
CACHE = 200_000
#: 64-bit words of a node's bitmap.
SKETCH = 32
#: Sets below the lowest nodes of the trees over a leaf's sets.
WIDTH = 2


class Hashes:
    """Whole texts to sorted distinct hashes of their word n-grams."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, tokens: list[bytes]) -> np.ndarray:
        if new := set(tokens).difference(self.known):
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = set(tokens)
            digest = xxhash.xxh64_intdigest
            self.known.update({t: digest(t) for t in new})
        return np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))

    def __call__(self, text: str, n: int) -> np.ndarray:
        ids = self.words(text.encode().lower().split())
        n = min(n, len(ids))
        if not n:
            return ids
        h = np.full(len(ids) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ ids[k : len(ids) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(h ^ (h >> np.uint64(32)))


def _hashes() -> Hashes:
    return held("hashes", Hashes)


def least_overlap(n: int, percent: int) -> int:
    """How many n-grams a set of ``n`` shares with a partner at least."""
    return -(-percent * n // 100)


def surplus(n: int, percent: int) -> int:
    """r: by how many n-grams, and one more, a prefix exceeds what a set can lack."""
    return 1 + max((n - least_overlap(n, percent)) // HALF, min(n // THIRD, FEW))


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + surplus(n, percent))


def _least_overlap(n, percent: int) -> Column:
    return F.floor((n * percent + 99) / F.lit(100))


def _surplus(n, percent: int) -> Column:
    lack = n - _least_overlap(n, percent)
    return 1 + F.greatest(F.floor(lack / F.lit(HALF)), F.least(F.floor(n / F.lit(THIRD)), F.lit(FEW)))


def _shared(percent: int) -> Column:
    """How many n-grams two linked sets have in both prefixes, at least, whatever the
    partner's size: the surplus grows with the size, and a partner has ``least_overlap``
    n-grams at least."""
    m = _least_overlap(F.col("n"), percent)
    return F.least(m, _surplus(m, percent)).cast("int")


class Parts:
    """Keys of sets by ranges of hashes: linked sets have one in common at least.

    A set has the keys of its class of size, and of the one below if a partner can lie there.
    A class has 1 + ``spare`` ranges more than its linked sets can differ by n-grams, so as
    many are the same in both. Ranges of more than ``WEAK`` n-grams are keys. A set with more
    than ``spare`` others has its first n-grams as keys too, as many as it can lack of a
    partner and one more: if all ranges that two sets share are weak, both have these."""

    def __init__(self, percent: int):
        self.percent, low = percent, 1
        self.lows, self.ranges, self.spares = [], [], []
        while low < 2**31:
            end = max(low + 1, math.ceil(low * max(RATIO, 100 / percent)) + 1)
            apart = (end - 1 + 100 * (end - 1) // percent) * (100 - percent) // (100 + percent)
            self.lows.append(low)
            self.spares.append((apart + 1) // SPARE)
            self.ranges.append(apart + 1 + self.spares[-1] if apart else 0)
            low = end

    def __call__(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        at = bisect.bisect_right(self.lows, n) - 1
        least = least_overlap(n, self.percent)
        own = [at, at - 1] if at and least < self.lows[at] else [at]
        return np.concatenate([np.zeros(0, np.uint64), *(self.keys(h, c, n - least + 1) for c in own if n and self.ranges[c])])

    def keys(self, h: np.ndarray, c: int, first: int) -> np.ndarray:
        place = (h >> np.uint64(32)) * np.uint64(self.ranges[c]) >> np.uint64(32)
        begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        strong = np.diff(begins, append=len(h)) > WEAK
        found = np.add.reduceat(h, begins)[strong]
        if self.ranges[c] - len(found) > self.spares[c]:
            found = np.concatenate([found, ~h[:first]])
        found = (found ^ np.uint64(c + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        return (found ^ (found >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def sketch_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, rid, TAGS, n, dig, low, first, near: size and digest of each text's set, its least
    n-gram, and the n-grams with the smallest hashes, as many as its prefix has; or the
    keys by parts, each in the first document of a batch that has it, others having that
    document's rid in ``near``, so that a key occurs once a batch however frequent it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts = _hashes(), Parts(percent) if percent >= BY_PARTS else None
        for batch in batches:
            n, dig, low, first = [], [], [], []
            seen: set[bytes] = set()
            for text in batch.column("text"):
                h = hashes(text.as_py(), words)
                n.append(len(h))
                dig.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                low.append(int(h[:1].view(np.int64)[0]) if len(h) else None)
                if parts is None:
                    first.append(h[: prefix_length(len(h), percent)].view(np.int64))
                else:
                    first.append((parts(h) & ROUND).view(np.int64) if dig[-1] not in seen else np.zeros(0, np.int64))
                    seen.add(dig[-1])
            near = [np.zeros(0, np.int64)] * len(n)
            if parts is not None:
                first, near = once(first, batch.column("rid").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(low, pa.int64()), _lists(first), _lists(near)], [*kept, "n", "dig", "low", "first", "near"])

    kept = ["doc_id", "rid", *TAGS]
    rows = documents(docs).select("*", F.monotonically_increasing_id().alias("rid"), *tags(F.col("text")))
    return rows.mapInArrow(run, "doc_id long, rid long, tag_a long, tag_b int, n long, dig binary, low long, first array<long>, near array<long>")


#: Bits of a key that are kept. Equal keys only make candidates, and shorter ones less to shuffle.
ROUND = np.uint64(0xFFFFFFFFFFFF0000)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def once(keys: list[np.ndarray], rids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The keys of each row that no row before has, and the rids of the rows that were the
    first to have the others."""
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat = np.concatenate([np.zeros(0, np.int64), *keys])
    _, at, which = np.unique(flat, return_index=True, return_inverse=True)
    head = row[at][which]
    own, ends = head == row, np.arange(1, len(keys))
    ties = np.unique(row[~own] * len(keys) + head[~own])
    by, to = np.divmod(ties, max(1, len(keys)))
    return np.split(flat[own], np.searchsorted(row[own], ends))[: len(keys)], np.split(rids[to], np.searchsorted(by, ends))[: len(keys)]


def tied_by_parts(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b: pairs of nodes that tie together all that have a key by parts in common. Keys
    are shuffled once. Copies of a node's set count as the node."""
    keys = sets.select(F.explode("first").alias("h"), "rid")
    ties = keys.select("rid", F.min("rid").over(W.partitionBy("h")).alias("to")).where("rid <> to")
    ties = cut(ties.unionByName(sets.select("rid", F.explode("near").alias("to"))).distinct(), "ties")
    copies = sets.select("dig", "rid").join(groups.where("copies > 1").select("dig", "node"), "dig").where("rid <> node").select("rid", "node")
    for c in ("rid", "to"):
        ties = ties.join(copies.select(F.col("rid").alias(c), F.col("node").alias(f"{c}_node")), c, "left").withColumn(c, F.coalesce(f"{c}_node", c)).drop(f"{c}_node")
    return ties.where("rid <> to").select(F.col("to").alias("a"), F.col("rid").alias("b"))


def with_partners(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """node, n, first of the nodes that share enough of their prefix with others. An n-gram
    is of one node alone if it occurs as often as the node has copies, in the node itself.
    Only n-grams and counts are shuffled, summed up map-side."""
    places = sets.select("rid", F.explode("first").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min("rid").alias("node"))
    alone = places.groupBy("node", "copies").agg(F.count(F.lit(1)).alias("alone"))
    length = F.least(F.col("n"), F.col("n") - _least_overlap(F.col("n"), percent) + _surplus(F.col("n"), percent))
    left = groups.join(alone, ["node", "copies"], "left").where(length - F.coalesce("alone", F.lit(0)) >= _shared(percent))
    left = cut(left.select("node"), "left")
    few = F.broadcast(left) if left.count() <= BROADCAST_KEYS else left
    return cut(sets.join(few, F.col("rid") == F.col("node")).select("node", "n", "first"), "prefixes")


def met(grams: DataFrame, shared: DataFrame) -> DataFrame:
    """node, n, df, h, size: the n-grams of ``grams`` (node, n, size, h) that ``shared`` (h,
    size, nodes) has in their class of size or the one below; df is the same for all sets. An
    n-gram has few classes, so they are gathered, and each n-gram of a node is shuffled once."""
    order = shared.groupBy("h").agg(F.sum("nodes").alias("df"), F.collect_list("size").alias("sizes"))
    own = F.array_intersect(F.array("size", F.col("size") - 1), "sizes")
    return grams.join(order, "h").select("node", "n", "df", "h", F.explode(own).alias("size"))


def prefix_keys(left: DataFrame, percent: int) -> DataFrame:
    """node, h, size: linked nodes of ``with_partners`` have a key (h, size) in common.
    Linked sets lie in the same class of size or in neighbouring ones (a little wider than
    the limit), so only n-grams that are shared there count; a node needs as many as before,
    and of these all but the most frequent become keys."""
    size = F.floor(F.log(F.col("n")) / F.lit(1.0001 * math.log(100 / percent)))
    grams = left.select("node", "n", size.alias("size"), F.explode("first").alias("h"))
    both = grams.select("h", F.explode(F.array("size", F.col("size") - 1)).alias("size"))
    shared = cut(both.groupBy("h", "size").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1"), "shared")
    found = met(grams, shared).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h", "size"))).alias("all"))
    common = F.array_distinct(F.expr("transform(all, x -> x.h)"))
    found = found.withColumn("picked", F.slice(common, F.lit(1), F.greatest(F.size(common) - _shared(percent) + 1, F.lit(0))))
    keys = found.select("node", F.explode(F.expr("filter(all, x -> array_contains(picked, x.h))")).alias("k"))
    return cut(keys.select("node", "k.h", "k.size"), "keys")


def candidate_edges(keys: DataFrame) -> DataFrame:
    """a, b: pairs that tie together all nodes that have a key in common."""
    heads = cut(keys.groupBy("h", "size").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("df")).where("df > 1").drop("df"), "heads")
    return keys.join(heads, ["h", "size"]).where("a <> node").select("a", F.col("node").alias("b")).distinct()


# ---- signature trees -------------------------------------------------------------


class Tree:
    """Binary tree over sets in order of size: (lo, hi) of the order, OR of bitmaps,
    range of sizes, least number of bits of a set, children."""

    __slots__ = ("items", "bits", "n_min", "n_max", "least", "kids")

    def __init__(self, items: list[int], sizes: list[int], bitmaps: list[int], width: int = WIDTH):
        self.items, self.kids = items, ()
        if len(items) > width:
            half = len(items) // 2
            self.kids = Tree(items[:half], sizes, bitmaps, width), Tree(items[half:], sizes, bitmaps, width)
            parts = self.kids
            self.bits, self.least = parts[0].bits | parts[1].bits, min(p.least for p in parts)
            self.n_min, self.n_max = min(p.n_min for p in parts), max(p.n_max for p in parts)
        else:
            self.bits = 0
            for i in items:
                self.bits |= bitmaps[i]
            self.least = min(bitmaps[i].bit_count() for i in items)
            self.n_min, self.n_max = min(sizes[i] for i in items), max(sizes[i] for i in items)


class Join:
    """Links between sets, as far as they connect what was not connected. ``visited`` and
    ``pruned`` count pairs of different nodes that the traversal met and cut off."""

    def __init__(self, sets: list[np.ndarray], classes: list, percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = [len(s) for s in sets]
        width = 1 << max(10, min(16, (4 * max(self.sizes)).bit_length()))
        self.bitmaps = []
        for s in sets:
            flags = np.zeros(width, bool)
            flags[(s >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)] = True
            self.bitmaps.append(int.from_bytes(np.packbits(flags).tobytes(), "big"))
        first: dict = {}
        self.up = [first.setdefault(c, i) for i, c in enumerate(classes)]
        self.links: list[tuple[int, int]] = []
        self.visited = self.pruned = 0

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tree(self, items: list[int]) -> Tree:
        return Tree(sorted(items, key=lambda i: (self.sizes[i], int(self.sets[i][0]))), self.sizes, self.bitmaps)

    def may(self, x: Tree, y: Tree) -> bool:
        """Whether a set of x and one of y can be linked, by sizes and by the most overlap."""
        t = self.percent
        if 100 * x.n_max < t * y.n_min or 100 * y.n_max < t * x.n_min:
            return False
        both = (x.bits & y.bits).bit_count()
        most = min(x.n_max - max(0, x.least - both), y.n_max - max(0, y.least - both))
        return (100 + t) * most >= t * (x.n_min + y.n_min)

    def compare(self, i: int, j: int) -> None:
        a, b, t = self.sizes[i], self.sizes[j], self.percent
        if 100 * min(a, b) < t * max(a, b):
            return
        x, y = self.bitmaps[i], self.bitmaps[j]
        both = (x & y).bit_count()
        most = min(a - x.bit_count() + both, b - y.bit_count() + both)
        if (100 + t) * most < t * (a + b):
            return
        p, q = self.find(i), self.find(j)
        if p == q:
            return
        overlap = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        if 100 * overlap >= t * (a + b - overlap):
            self.up[max(p, q)] = min(p, q)
            self.links.append((i, j))

    def traverse(self, x: Tree, y: Tree) -> None:
        stack = [(x, y)]
        while stack:
            x, y = stack.pop()
            if x is not y:
                self.visited += 1
                if not self.may(x, y):
                    self.pruned += 1
                    continue
            if x is y and x.kids:
                a, b = x.kids
                stack += [(a, b), (a, a), (b, b)]
            elif x is y:
                for k, i in enumerate(x.items):
                    for j in x.items[k + 1 :]:
                        self.compare(i, j)
            elif x.kids and (not y.kids or len(x.items) >= len(y.items)):
                stack += [(k, y) for k in x.kids]
            elif y.kids:
                stack += [(x, k) for k in y.kids]
            else:
                for i in x.items:
                    for j in y.items:
                        self.compare(i, j)


def join_within(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(rid, cluster, comp, large, pivot, visits) of a block: comp is the smallest rid that
    a member or a visiting pivot is connected with in the leaf."""
    out = []
    for _, own in pdf.drop_duplicates("rid").groupby(["cluster", "leaf"], sort=False):
        own = own.sort_values("rid")
        ids = own["rid"].tolist()
        j = Join([np.frombuffer(b, np.uint64) for b in own["grams"]], ids, percent)
        root = j.tree(list(range(len(own))))
        j.traverse(root, root)
        out.append(own[["rid", "cluster", "large", "pivot", "visits"]].assign(comp=[ids[j.find(i)] for i in range(len(ids))]))
    return pd.concat(out)[["rid", "cluster", "comp", "large", "pivot", "visits"]]


def join_visitors(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) between the components of a leaf's members and of its visitors."""
    own, other = pdf[~pdf["visits"]], pdf[pdf["visits"]]
    if not len(own) or not len(other):
        return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    both = pd.concat([own, other])
    j = Join([np.frombuffer(b, np.uint64) for b in both["grams"]], both["comp"].tolist(), percent)
    j.traverse(j.tree(list(range(len(own)))), j.tree(list(range(len(own), len(both)))))
    ids = both["comp"].tolist()
    return pd.DataFrame([(ids[a], ids[b]) for a, b in j.links], columns=["a", "b"]).astype("int64")


# ---- clusters --------------------------------------------------------------------


def members_texts(docs: DataFrame, members: DataFrame, count: int) -> DataFrame:
    """``members`` (``count`` rows) with their texts, found by doc_id and the text's tags;
    repeated rows come repeatedly. Where members are too many for a broadcast, a number made
    of id and tags is broadcast first, in turns, so that no other texts are shuffled."""
    wanted = members.withColumnsRenamed({"doc_id": "id"} | {t: f"own_{t}" for t in TAGS})
    rows = documents(docs)
    if count <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    else:
        turns, whole = -(-count // BROADCAST_KEYS), rows.withColumn("key", F.xxhash64("doc_id", *tags(F.col("text"))))
        keys = members.select(F.xxhash64("doc_id", *TAGS).alias("key")).distinct()
        found = [whole.join(F.broadcast(keys.where(F.pmod("key", F.lit(turns)) == k)), "key", "left_semi") for k in range(turns)]
        rows = reduce(DataFrame.unionByName, found).drop("key")
    same = [t == F.col(f"own_{name}") for t, name in zip(tags(F.col("text")), TAGS, strict=True)]
    return rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & same[0] & same[1])


def once_a_task(rows: DataFrame) -> DataFrame:
    """rid, dig, cluster, block, text of ``rows``, repeated ones once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys = [(rid, hash(text)) for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            mine = [key not in seen and not seen.add(key) for key in keys]
            yield batch.filter(pa.array(mine, pa.bool_()))

    return rows.select("rid", "dig", "cluster", "block", "text").mapInArrow(run, "rid long, dig binary, cluster long, block long, text string")


def join_texts(pdf: pd.DataFrame, words: int, percent: int) -> pd.DataFrame:
    """(rid, comp) of a block of small clusters, whose sets are made of their texts."""
    hashes = _hashes()
    pdf = pdf.assign(grams=[hashes(t, words).tobytes() for t in pdf["text"]], leaf=0, large=False, pivot=False, visits=False)
    right = [hashlib.blake2b(g, digest_size=16).digest() == d for g, d in zip(pdf["grams"], pdf["dig"], strict=True)]
    return join_within(pdf[right], percent)[["rid", "comp"]]


def gram_table(docs: DataFrame, members: DataFrame, count: int, words: int) -> DataFrame:
    """``members`` (rid, doc_id, TAGS, dig, cluster, block, place, leaf, large; ``count`` rows) with n, their n-grams' hashes and a bitmap.
    Of repeated rows a task takes one."""
    rows = members_texts(docs, members, count)
    kept = ["rid", "dig", "cluster", "block", "place", "leaf", "large"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _hashes(), set()
        for batch in batches:
            grams, n, bits, mine = [], [], [], []
            for rid, text, dig in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("dig").to_pylist(), strict=True):
                h = hashes(text.as_py() if rid not in seen else "", words)
                raw = h.tobytes()
                mine.append(rid not in seen and hashlib.blake2b(raw, digest_size=16).digest() == dig)
                if mine[-1]:
                    seen.add(rid)
                flags = np.zeros(64 * SKETCH, bool)
                flags[(h % np.uint64(64 * SKETCH)).astype(np.int64)] = True
                bits.append(np.packbits(flags).view(np.int64).tolist())
                grams.append(raw)
                n.append(len(h))
            cols = [*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(grams, pa.binary()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "n", "grams", "bits"]).filter(pa.array(mine, pa.bool_()))

    out = rows.select(*kept, "text").mapInArrow(run, "rid long, dig binary, cluster long, block long, place long, leaf long, large boolean, n long, grams binary, bits array<long>")
    return out.drop("dig")


def dealt_to_leaves(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (rid, cluster, n, low) of large clusters with their place in the order of
    size and least n-gram as ``place``. Ranks are taken within bands of size, parted by the
    least n-gram and once more by the row, so that no task orders a cluster."""
    band = F.floor(2 * F.log(F.col("n")) / F.log(F.lit(100 / percent)))
    bucket = (band * 64 + F.pmod(F.xxhash64("low"), F.lit(64))) * 64 + F.pmod(F.xxhash64("rid"), F.lit(64))
    placed = ranked(rows.withColumn("bucket", bucket.cast("long")), ["cluster"], ["low", "rid"], "bucket", "place")
    return placed.drop("bucket")


def cluster_components(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """rid, comp of all nodes in ``clusters`` (node, comp), by links within clusters.
    ``nodes``: rid, doc_id, TAGS, dig, n, low."""
    sizes = clusters.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    rows = cut(nodes.join(clusters.join(sizes, "comp"), F.col("rid") == F.col("node")).select("rid", "doc_id", *TAGS, "dig", "n", "low", F.col("comp").alias("cluster"), "members"), "members")
    total = rows.count()
    large = dealt_to_leaves(rows.where(F.col("members") > LEAF), percent)
    small = rows.where(F.col("members") <= LEAF).withColumn("place", F.lit(0).cast("long"))
    placed = small.unionByName(large.select(small.columns)).withColumn("leaf", F.floor(F.col("place") / LEAF).cast("long"))
    block = F.when(F.col("members") > LEAF, F.xxhash64("cluster", "leaf")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(buckets_for(total, BLOCK))))
    members = placed.select("rid", "doc_id", *TAGS, "dig", "cluster", block.alias("block"), "place", "leaf", (F.col("members") > LEAF).alias("large"))
    texts = once_a_task(members_texts(docs, members.where("NOT large"), total))
    done = cut(texts.groupBy("block").applyInPandas(lambda pdf: join_texts(pdf, words, percent), "rid long, comp long"), "done")
    many = members.where("large").count()
    if not many:
        return done

    # each leaf with itself and with pivots of its cluster, which are drawn by a hash
    whole = cut(gram_table(docs, members.where("large"), many, words), "grams")
    draws = [F.min_by("rid", F.xxhash64("rid", F.lit(k))) for k in range(PIVOTS)]
    pivots = cut(whole.groupBy("cluster").agg(F.array_distinct(F.array(*draws)).alias("p")).select("cluster", F.explode("p").alias("rid")), "pivots")
    home = whole.select("block", "rid", "cluster", "leaf", "large", "grams").join(pivots.select("rid", F.lit(True).alias("pivot")), "rid", "left")
    home = home.withColumns({"pivot": F.coalesce("pivot", F.lit(False)), "visits": F.lit(False)})
    leaves = whole.select("cluster", "block", "leaf").distinct()
    guests = whole.select("rid", "grams", F.col("leaf").alias("own")).join(pivots, "rid").join(leaves, "cluster").where("leaf <> own")
    guests = guests.select("block", "rid", "cluster", "leaf", F.lit(True).alias("large"), "grams", F.lit(True).alias("pivot"), F.lit(True).alias("visits"))
    inner = home.unionByName(guests).groupBy("block").applyInPandas(lambda pdf: join_within(pdf, percent), "rid long, cluster long, comp long, large boolean, pivot boolean, visits boolean")
    parts = cut(inner, "parts")
    ties = parts.where("pivot").select(F.col("comp").alias("a"), F.col("rid").alias("b"))
    parts = parts.where("NOT visits").select("rid", "cluster", "comp")
    parts = _merged(parts, ties)

    # what is outside its cluster's main part visits the leaves that may hold a partner
    sized = parts.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = sized.groupBy("cluster").agg(F.max_by("comp", "size").alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    main = cut(main, "main")
    if main.isEmpty():
        return done.unionByName(parts.select("rid", "comp"))
    crowd = cut(whole.join(parts.select("rid", "comp"), "rid").join(main, "cluster").select("rid", "cluster", F.floor(F.col("place") / _twig()).cast("long").alias("twig"), "n", "bits", "comp", (F.col("comp") != F.col("main")).alias("stray")), "crowd")
    levels = tree_levels(crowd)
    visits = visits_of(crowd, levels[0], traversed(levels, percent), percent)
    parts = _merged(parts, _visited(whole.join(main.select("cluster"), "cluster"), visits, parts, percent))
    return done.unionByName(parts.select("rid", "comp"))


def _twig() -> int:
    """Sets of the lowest level's nodes."""
    return max(1, LEAF // FAN)


_OR = [f"o{k}" for k in range(SKETCH)]


def tree_levels(crowd: DataFrame) -> list[DataFrame]:
    """The levels of the clusters' trees, twigs first, up to one with a node for each
    cluster: cluster, id, up (the parent's id), n_min, n_max, least, c_min, c_max, and the
    OR of the bitmaps."""
    facts = [F.min("n_min").alias("n_min"), F.max("n_max").alias("n_max"), F.min("least").alias("least"), F.min("c_min").alias("c_min"), F.max("c_max").alias("c_max"), *(F.bit_or(o).alias(o) for o in _OR)]
    bits = sum((F.bit_count(F.col("bits")[k]) for k in range(SKETCH)), F.lit(0))
    below = crowd.select("cluster", F.col("twig").alias("up"), F.col("n").alias("n_min"), F.col("n").alias("n_max"), bits.alias("least"), F.col("comp").alias("c_min"), F.col("comp").alias("c_max"), *(F.col("bits")[k].alias(o) for k, o in enumerate(_OR)))
    levels = []
    while True:
        level = below.groupBy("cluster", F.col("up").alias("id")).agg(*facts)
        levels.append(cut(level.withColumn("up", F.floor(F.col("id") / FAN).cast("long") if levels else _leaf("id")), "level"))
        below = levels[-1]
        if (below.agg(F.max("id")).first()[0] or 0) == 0:
            return levels


def _leaf(twig: str) -> Column:
    return F.floor(F.col(twig) * _twig() / F.lit(LEAF)).cast("long")


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether sets below two nodes can be linked and are not connected yet: by sizes, by
    the most overlap that the bitmaps leave, and by components."""
    c = lambda side, name: F.col(f"{side}.{name}")
    both = sum((F.bit_count(c(x, o).bitwiseAND(c(y, o))) for o in _OR), F.lit(0))
    most = F.least(*(c(s, "n_max") - F.greatest(F.lit(0), c(s, "least") - both) for s in (x, y)))
    sizes = (100 * c(x, "n_max") >= percent * c(y, "n_min")) & (100 * c(y, "n_max") >= percent * c(x, "n_min"))
    connected_already = (F.greatest(c(x, "c_max"), c(y, "c_max")) == F.least(c(x, "c_min"), c(y, "c_min")))
    return ~connected_already & ((c(x, "id") == c(y, "id")) | sizes & ((100 + percent) * most >= percent * (c(x, "n_min") + c(y, "n_min"))))


def traversed(levels: list[DataFrame], percent: int) -> DataFrame:
    """(cluster, x, y) with x < y: the pairs of leaves that the dual traversal leaves. A
    level's pairs are joined with the children of both nodes, and cut off there."""
    top = levels[-1]
    pairs = top.select("cluster", F.col("id").alias("x"), F.col("id").alias("y"))
    for level in levels[-2:0:-1]:
        x, y = level.alias("x"), level.alias("y")
        met = pairs.alias("p").join(x, (F.col("p.cluster") == F.col("x.cluster")) & (F.col("p.x") == F.col("x.up"))).join(y, (F.col("p.cluster") == F.col("y.cluster")) & (F.col("p.y") == F.col("y.up")))
        met = met.where(F.col("x.id") <= F.col("y.id")).where(may_link("x", "y", percent))
        pairs = cut(met.select(F.col("p.cluster").alias("cluster"), F.col("x.id").alias("x"), F.col("y.id").alias("y")), "pairs")
    return pairs.where("x < y")


def visits_of(crowd: DataFrame, twigs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(rid, cluster, leaf): with which leaves of ``pairs`` a set outside its cluster's main
    part can be linked, by its bitmap against those of the leaf's twigs."""
    sides = pairs.select("cluster", F.col("x").alias("own"), F.col("y").alias("leaf"))
    sides = sides.unionByName(pairs.select("cluster", F.col("y").alias("own"), F.col("x").alias("leaf")))
    leaves = twigs.groupBy("cluster", F.col("up").alias("leaf")).agg(F.collect_list(F.struct("n_min", "n_max", "c_min", "c_max", F.array(*_OR).alias("o"))).alias("twigs"))
    strays = crowd.where("stray").select("rid", "cluster", _leaf("twig").alias("own"), "n", "bits", "comp")
    asked = strays.join(sides, ["cluster", "own"]).join(leaves, ["cluster", "leaf"])
    n = F.col("n")

    def fits(x: Column) -> Column:
        missing = F.aggregate(F.zip_with("bits", x["o"], lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda a, b: a + b)
        sizes = (100 * x["n_max"] >= percent * n) & (100 * n >= percent * x["n_min"])
        apart = (x["c_min"] != F.col("comp")) | (x["c_max"] != F.col("comp"))
        return sizes & apart & ((100 + percent) * (n - missing) >= percent * (n + x["n_min"]))

    return asked.where(F.exists("twigs", fits)).select("rid", "cluster", "leaf")


def _visited(whole: DataFrame, visits: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, from ``visits`` (rid, cluster, leaf) to leaves. A
    group is a leaf and one block of its visitors; leaves without visitors stay away."""
    visits = cut(visits, "visits")
    hosts = cut(visits.groupBy("cluster", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(LEAF)).alias("blocks")), "hosts")
    cols = ["cluster", "leaf", "part", "rid", "grams"]
    dealt = visits.join(hosts, ["cluster", "leaf"]).withColumn("part", F.pmod(F.xxhash64("rid", "leaf"), F.col("blocks")))
    guests = dealt.join(whole.select("rid", "grams"), "rid").select(*cols, F.lit(True).alias("visits"))
    own = whole.join(hosts, ["cluster", "leaf"]).withColumn("part", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = own.select(*cols, F.lit(False).alias("visits")).unionByName(guests)
    return rows.join(parts.select("rid", "comp"), "rid").groupBy("cluster", "leaf", "part").applyInPandas(lambda pdf: join_visitors(pdf, percent), "a long, b long")


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` (rid, cluster, comp) after ``links`` between components."""
    found = connected(links).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return cut(parts.join(found, "comp", "left").select("rid", "cluster", F.coalesce("to", "comp").alias("comp")), "parts")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``: rows whose sets of
    ``words``-word n-grams have a Jaccard similarity of ``percent`` / 100 or more are linked."""
    return _components(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """As ``jaccard_components``, with ``rid``, which tells rows apart, ``comp``, one of the
    component's, and the text's TAGS."""
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    sets = cut(sketch_sets(docs, words, percent), "sets")
    total = sets.count()
    full = sets.where("n > 0")
    groups = full.groupBy("dig").agg(F.min("rid").alias("node"), *(F.min_by(c, "rid").alias(c) for c in ("doc_id", *TAGS)), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("low").alias("low"))
    groups = cut(groups, "groups")
    if percent < 100:
        if percent >= BY_PARTS:
            clusters = connected(tied_by_parts(full, groups))
        else:
            clusters = connected(candidate_edges(prefix_keys(with_partners(full, groups, percent), percent)))
        wide, sets = sets, cut(sets.drop("first", "near"), "rows")
        forget(wide)
        full = sets.where("n > 0")
        found = cluster_components(docs, groups.select(F.col("node").alias("rid"), "doc_id", *TAGS, "dig", "n", "low"), clusters, words, percent).withColumnRenamed("rid", "node")
        joined = groups.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    else:  # equal sets alone are linked
        joined = groups.withColumn("comp", F.col("node"))
    least = joined.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    facts = cut(joined.join(least, "comp").select("dig", "copies", "component_id", "comp"), "facts")
    out = attach(full.select("doc_id", "rid", *TAGS, "n", "dig"), facts, "dig", "copies", total).select("doc_id", "rid", *TAGS, F.col("n").alias("n_shingles"), "component_id", "comp")
    empty = sets.where("n = 0")
    return out.unionByName(empty.select("doc_id", "rid", *TAGS, F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("rid").alias("comp")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with their columns, that stay: of each component one row with
    the smallest doc_id, without an id only if no member has one. Documents that are linked
    with nothing stay as they are, texts without words included."""
    found = cut(_components(docs, words, percent), "components")
    best = found.groupBy("comp").agg(F.coalesce(F.min_by("rid", "doc_id"), F.min("rid")).alias("rid")).select("rid", F.lit(True).alias("best"))
    return only_marked(docs, found.join(best, "rid", "left").withColumn("stays", F.coalesce("best", F.lit(False))))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)


#: Every pair of linked rows and their closure; for small tables.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reached AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT s.doc_id, len(s.grams) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c USING (doc_id)
"""
