"""Near duplicates by a chosen-path set similarity join over minwise tokens.

A set of word n-grams is reduced to ``TOKENS`` minwise tokens: for each of so many hash
functions the n-gram with the least value. Trees of documents are grown from them. The root
of a tree picks two functions, any other node one or two, 1 / similarity on average; a
document goes to a child for each function picked, named by the path and by the document's
token. So a linked pair is expected to share a child of each node that it shares, while
others part soon. Independent trees are repeated until a pair at the limit, in nodes of depth
``DEEP``, is met with the recall asked for; pairs above it, or in nodes that are small
sooner, are met more surely.

The trees start with nodes of depth ``START``, which need no look at other documents, and
grow a level at a time, as tables (node, document). A node whose documents are all
connected is dropped. Where all but ``LIMIT`` documents are of one component, they are
compared with all of the node, exhaustively, and the node ends. A larger node is dealt to
blocks, each compared in itself and with a few pivots of the node, which connects what is
dense, and then branched on. Blocks are of bounded size, whatever a node has; a node of the
last level ends in pairs of blocks, all of its documents outside the main component against
all. Comparisons are of sketches, a byte of each token; what passes is confirmed on the full
sets, which are made again from the texts of the few documents in question and sent once to
what groups of alike documents overlap. Documents lie bucketed by their row number, so a level
moves what it compares and no others' tokens, however many levels there are. The first nodes
of one tree go alone, so that the trees, which are grown then, meet most groups of copies as
one component.

Documents with equal sets are one. Sets so small that only equal ones are linked grow no tree.

Defined cases: null and empty texts, and texts without words, have empty sets, which are
linked with nothing; a text of fewer words than an n-gram has one n-gram, the whole; a text
of any length is taken whole; sets at the limit exactly are linked; repeated rows have
equal sets; a null doc_id is its component only if no member has an id, and is kept only
then; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from emrecon.llm.common import BROADCAST_IDS, TAGS, attach, buckets_for, cut, documents, tags
from emrecon.llm.components import connected
from emrecon.llm.jaccard_join import Join, _hashes
from emrecon.sources.scratch import bucketed

#: Minwise tokens of a set; functions that a root picks.
TOKENS, ROOT = 128, 2
#: Documents outside a node's main component up to which it ends, and documents of a block.
LIMIT, BLOCK = 512, 512
#: Documents of a large node that all its blocks are compared with.
PIVOTS = 4
#: Depth of the first nodes, depth for which the number of trees is counted, and the last one.
START, DEEP, DEPTH = 3, 6, 10
#: Standard deviations by which a sketch may fall short of the limit.
SURE = 4.5
#: Groups of a document, in the mean, above which overlapping groups are made one.
OFTEN = 2
#: n-grams whose hash values are taken at once.
SLICE = 1024
#: Documents of a bucket of the representatives, about, where a shuffle has no more partitions.
IN_BUCKET = 250_000

_random = random.Random(20)
_XOR = np.array([_random.getrandbits(32) for _ in range(TOKENS)], np.uint32)[:, None]
_TIMES = np.array([_random.getrandbits(32) | 1 for _ in range(TOKENS)], np.uint32)[:, None]
_ORDER = _random.sample(range(TOKENS), TOKENS)


def tokens(grams: np.ndarray) -> np.ndarray:
    """The least hash value of a set of 64-bit n-grams under each function."""
    x = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), SLICE):
        values = (x[None, at : at + SLICE] ^ _XOR) * _TIMES
        np.minimum(out, (values ^ (values >> np.uint32(15))).min(1), out=out)
    return out


def branches(percent: int) -> tuple[int, float]:
    """Functions that a node picks: so many, and one more with this probability."""
    return 100 // percent, 100 / percent - 100 // percent


def missed(percent: int, depth: int) -> float:
    """The probability that a pair at the limit shares no node of this depth in a tree."""
    p, (whole, more) = percent / 100, branches(percent)
    q = 0.0
    for _ in range(depth - 1):
        u = 1 - p + p * q
        q = u**whole * (1 - more + more * u)
    return (1 - p + p * q) ** ROOT


def trees_for(recall: float, percent: int, depth: int = DEEP) -> int:
    q = missed(percent, depth)
    return 1 if q == 0 else min(TOKENS // ROOT, max(1, math.ceil(math.log(1 - recall) / math.log(q))))


def least_matches(percent: int) -> int:
    p = percent / 100
    return max(1, math.floor(TOKENS * p - SURE * math.sqrt(TOKENS * p * (1 - p))))


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, rid, TAGS, n, dig, mins: size, digest and minwise tokens of each text's set. A
    token is two bytes: the first ones of all tokens, which are the sketch, come first."""
    kept = ["doc_id", "rid", *TAGS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes()
        for batch in batches:
            n, dig, mins = [], [], np.empty((batch.num_rows, TOKENS), np.uint32)
            for k, text in enumerate(batch.column("text")):
                h = hashes(text.as_py(), words)
                n.append(len(h))
                dig.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                mins[k] = tokens(h)
            both = [row.tobytes() for row in np.concatenate([mins, mins >> np.uint32(8)], 1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(both, pa.binary())], [*kept, "n", "dig", "mins"])

    rows = documents(docs).select("*", F.monotonically_increasing_id().alias("rid"), *tags(F.col("text")))
    return rows.mapInArrow(run, "doc_id long, rid long, tag_a long, tag_b int, n long, dig binary, mins binary")


def representatives(sets: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """The rows of ``sets`` that stand for ``groups`` (node), bucketed by rid: they are moved
    here, and no join by rid moves them again."""
    buckets = buckets_for(total, IN_BUCKET, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = sets.repartition(buckets, "rid").join(groups.select(F.col("node").alias("rid")), "rid")
    return bucketed(own.select(sets.columns), "rid", buckets, dealt=True)


# ---- trees -----------------------------------------------------------------------


def _child(node: Column, i: Column) -> Column:
    """The child that a document goes to by function ``i``."""
    first, second = (F.substring("mins", i + 1 + at, F.lit(1)) for at in (0, TOKENS))
    return F.xxhash64(node, i, first, second)


def children(rows: DataFrame, percent: int) -> DataFrame:
    """(node, rid, mins) of the next level, from rows of the same columns."""
    whole, more = branches(percent)
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(TOKENS))
    step = 2 * F.pmod(F.xxhash64("node", F.lit(2)), F.lit(TOKENS // 2)) + 1  # another function for the second
    number = whole + (F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 20)) < F.lit(int(more * (1 << 20)))).cast("int")
    child = F.transform(F.sequence(F.lit(0), number - 1), lambda k: _child(F.col("node"), F.pmod(first + k * step, F.lit(TOKENS)).cast("int")))
    return rows.select(F.explode(child).alias("node"), "rid", "mins")


def roots(reps: DataFrame, trees: range, percent: int, depth: int = START) -> DataFrame:
    """(node, rid) of the first nodes, at this depth."""
    child = [_child(F.lit(t), F.lit(i)) for t in trees for i in _ORDER[ROOT * t : ROOT * t + ROOT]]
    rows = reps.select(F.explode(F.array(*child)).alias("node"), "rid", "mins")
    for _ in range(depth - 1):
        rows = children(rows, percent)
    return rows.select("node", "rid")


def grown(live: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(node, rid) of the next level, from the nodes in ``live``."""
    return children(live.join(reps.select("rid", "mins"), "rid"), percent).select("node", "rid")


def mixed(live: DataFrame, comps: DataFrame | None) -> DataFrame:
    """node, rid, comp, main, size, strays of the nodes with more than one component: the
    one with most documents, all documents, and those outside it. Without ``comps`` each
    document is one. Most nodes have one document and are dropped before anything is joined."""
    shared = cut(live.groupBy("node").count().where("count > 1").select("node"), "shared")
    few = F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared
    rows = live.join(few, "node", "left_semi")
    rows = rows.withColumn("comp", F.col("rid")) if comps is None else rows.join(comps, "rid").select("node", "rid", "comp")
    rows = cut(rows, "level")
    parts = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("own"))
    nodes = parts.groupBy("node").agg(F.count(F.lit(1)).alias("parts"), F.sum("own").alias("size"), F.max("own").alias("most"), F.max_by("comp", "own").alias("main"))
    nodes = nodes.where("parts > 1").select("node", "main", "size", (F.col("size") - F.col("most")).alias("strays"))
    return cut(rows.join(nodes, "node"), "mixed")


def _blocks(n: str, each: int) -> Column:
    return F.ceil(F.col(n) / F.lit(each)).cast("int")


def _at(of: Column, *keys) -> Column:
    return F.pmod(F.xxhash64("rid", "node", *keys), of).cast("int")


def _each(of: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), of - 1))


def ended(rows: DataFrame) -> DataFrame:
    """(g, rid, comp): groups of about BLOCK and LIMIT documents at most, in which each
    document outside its node's main component meets each of the node."""
    x, y = _blocks("size", BLOCK), _blocks("strays", LIMIT)
    own = rows.select("node", "rid", "comp", _at(x).alias("x"), _each(y).alias("y"))
    strays = rows.where((F.col("comp") != F.col("main")) & (x * y > 1)).select("node", "rid", "comp", _each(x).alias("x"), _at(y, F.lit(1)).alias("y"))
    return own.unionByName(strays).select(F.xxhash64("node", "x", "y").alias("g"), "rid", "comp")


def dealt(rows: DataFrame) -> DataFrame:
    """(g, rid, comp): the documents of large nodes in blocks, with the node's pivots."""
    x = _blocks("size", BLOCK)
    draws = [F.min_by("rid", F.xxhash64("rid", F.lit(k))) for k in range(PIVOTS)]
    pivots = rows.groupBy("node").agg(F.array_distinct(F.array(*draws)).alias("p"), F.first("size").alias("size"))
    pivots = pivots.select("node", "size", F.explode("p").alias("rid")).join(rows.select("node", "rid", "comp"), ["node", "rid"]).select("node", "rid", "comp", _each(x).alias("x"))
    own = rows.select("node", "rid", "comp", _at(x).alias("x"))
    return own.unionByName(pivots).select(F.xxhash64("node", "x", F.lit(-1)).alias("g"), "rid", "comp")


# ---- comparison ------------------------------------------------------------------


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of g, as tables that hold all rows of their groups."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        g = table.column("g").to_numpy()
        last = int(np.searchsorted(g, g[-1]))
        if last:
            yield table.slice(0, last)
        rest = table.slice(last).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def alike(table: pa.Table, percent: int) -> pa.Table:
    """(g, rid, comp): groups of documents whose sketches tie them together, of those that
    share a group in ``table`` and are not connected yet. A group is named by its members."""
    g, rid = table.column("g").to_numpy(), table.column("rid").to_numpy()
    once = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (rid[1:] != rid[:-1])])
    g, rid, comp, n = (table.column(c).to_numpy()[once] for c in ("g", "rid", "comp", "n"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)[once]
    least, found, at = least_matches(percent), [], np.arange(len(g))
    for d in range(1, len(g)):
        at = at[at + d < len(g)]
        at = at[g[at] == g[at + d]]
        if not len(at):
            break
        a, b = n[at], n[at + d]
        pairs = at[(comp[at] != comp[at + d]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))]
        for k in range(0, len(pairs), 1 << 15):
            i = pairs[k : k + (1 << 15)]
            i = i[(sketch[i] == sketch[i + d]).sum(1) >= least]
            found.append(np.stack([i, i + d]))
    i, j = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    label = np.arange(len(g))
    while (label[i] != label[j]).any():
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
    members = np.unique(np.r_[i, j])
    mix = (rid[members].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    name = np.zeros(len(g), np.uint64)
    np.add.at(name, label[members], mix ^ (mix >> np.uint64(32)))
    return pa.table({"g": name[label[members]].view(np.int64), "rid": rid[members], "comp": comp[members]})


def compared(groups: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """``alike`` of all groups (g, rid, comp), each of them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            yield from alike(table, percent).to_batches()

    rows = groups.join(reps.select("rid", "n", F.substring("mins", 1, TOKENS).alias("sketch")), "rid").repartition("g").sortWithinPartitions("g", "rid")
    return rows.select("g", "rid", "comp", "n", "sketch").mapInArrow(run, "g long, rid long, comp long").distinct()


def overlapping(groups: DataFrame) -> DataFrame:
    """``groups`` with those that share members made one, which has all of their pairs and
    each member once, if it has ``LIMIT`` members at most; others stay as they are. Documents
    alike but not linked meet in most trees, each time in a group of somewhat other members."""
    heads = groups.groupBy("g").agg(F.min("rid").alias("a"))
    whole = connected(groups.join(heads, "g").select("a", F.col("rid").alias("b")))
    fits = whole.groupBy("comp").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") <= LIMIT).select("comp")
    named = whole.join(fits, "comp").select(F.col("node").alias("rid"), F.col("comp").alias("whole"))
    return groups.join(named, "rid", "left").select(F.coalesce("whole", "g").alias("g"), "rid", "comp").distinct()


def full_sets(docs: DataFrame, members: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """``members`` (rid and other columns) and grams: their sets, made from the texts. Rows are
    found by doc_id and the text's tags; of repeated rows a task takes one."""
    kept = members.columns
    keys = reps.select("rid", "dig", F.col("doc_id").alias("id"), *(F.col(t).alias(f"own_{t}") for t in TAGS)).join(members, "rid")
    keys = cut(keys, "wanted")
    wanted = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    a, b = tags(F.col("text"))
    rows = documents(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (a == F.col("own_tag_a")) & (b == F.col("own_tag_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _hashes(), set()
        for batch in batches:
            at, grams = [], []
            for k, (rid, dig, text) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("dig").to_pylist(), batch.column("text"), strict=True)):
                if rid not in seen:
                    raw = hashes(text.as_py(), words).tobytes()
                    if hashlib.blake2b(raw, digest_size=16).digest() == dig:
                        seen.add(rid)
                        at.append(k)
                        grams.append(raw)
            places = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(places) for c in kept), pa.array(grams, pa.binary())], [*kept, "grams"])

    return rows.select(*kept, "dig", "text").mapInArrow(run, StructType([*members.schema.fields, StructField("grams", BinaryType())]))


def sent(groups: DataFrame, docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """(g, rid, comp, grams): the groups with the full sets of their members. A member knows its
    groups before its set is made, so the set goes to them at once."""
    members = groups.groupBy("rid").agg(F.collect_list(F.struct("g", "comp")).alias("groups"))
    return full_sets(docs, members, reps, words).select("rid", "grams", F.inline("groups")).select("g", "rid", "comp", "grams")


def confirmed(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components, by the full sets in ``groups`` (g, rid, comp, grams)."""

    def links(table: pa.Table) -> list[tuple[int, int]]:
        rows = dict(zip(table.column("rid").to_pylist(), zip(table.column("comp").to_pylist(), table.column("grams").to_pylist(), strict=True), strict=True))
        comps = [c for c, _ in rows.values()]
        join = Join([np.frombuffer(g, np.uint64) for _, g in rows.values()], comps, percent)
        for i in range(len(comps)):
            for j in range(i):
                if join.find(i) != join.find(j):
                    join.compare(j, i)
        # as stars, which are components at once
        return [*{(comps[join.find(i)], c) for i, c in enumerate(comps) if comps[join.find(i)] != c}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            g = table.column("g").to_numpy()
            ends = [*np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
            found = [pair for lo, hi in zip([0, *ends[:-1]], ends, strict=True) for pair in links(table.slice(lo, hi - lo))]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return groups.repartition("g").sortWithinPartitions("g", "rid").mapInArrow(run, "a long, b long").distinct()


# ---- components ------------------------------------------------------------------


def path_components(docs: DataFrame, reps: DataFrame, words: int, percent: int, recall: float) -> DataFrame:
    """(rid, comp) of ``reps``, the documents with distinct sets."""
    comps = reps.select("rid", F.col("rid").alias("comp"))
    trees = trees_for(recall, percent)
    # the smallest partner of another size has one n-gram more
    able = reps.where(100 * F.col("n") >= percent * (F.col("n") + 1))
    first = True
    for wave in (range(1), range(trees)):
        live, depth = roots(able, wave, percent), START
        while live is not None:
            rows = mixed(live, None if first else comps)
            ends = F.col("strays") <= LIMIT if depth < DEPTH else F.lit(True)
            large = rows.where(~ends)
            groups = cut(compared(ended(rows.where(ends)).unionByName(dealt(large)), able, percent), "alike")
            if not groups.isEmpty():
                if groups.count() > OFTEN * groups.select("rid").distinct().count():
                    groups = cut(overlapping(groups), "merged_groups")
                links = cut(confirmed(sent(groups, docs, able, words), percent), "confirmed")
                moved = connected(links).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
                comps = cut(comps.join(moved, "comp", "left").select("rid", F.coalesce("to", "comp").alias("comp")), "comps")
            done = first or depth == DEPTH or large.isEmpty()
            live, depth, first = None if done else grown(large.select("node", "rid"), able, percent), depth + 1, False
    return comps


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = 0.9999) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``: rows whose sets of
    ``words``-word n-grams have a Jaccard similarity of ``percent`` / 100 or more are linked."""
    if not 50 <= percent <= 100 or not 0 < recall < 1:
        raise ValueError("percent is 50 to 100, recall between 0 and 1")
    sets = cut(sketched(docs, words), "sketches")
    total = sets.count()
    groups = sets.where("n > 0").groupBy("dig").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    groups = cut(groups, "groups")
    reps = representatives(sets, groups, total)
    found = path_components(docs, reps, words, percent, recall) if percent < 100 else reps.select("rid", F.col("rid").alias("comp"))
    joined = groups.join(found, F.col("node") == F.col("rid"))
    least = joined.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    facts = cut(joined.join(least, "comp").select("dig", "copies", "component_id"), "facts")
    out = attach(sets.where("n > 0").select("doc_id", "n", "dig"), facts, "dig", "copies", total)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2, 80)


#: Exact: linked sets share an n-gram of their prefixes, in the order of rarity; for small tables.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws[1]]
  ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
f AS (SELECT gram, count(*) AS df FROM g GROUP BY gram),
r AS (SELECT doc_id, n, gram, df, row_number() OVER (PARTITION BY doc_id ORDER BY df, gram) AS k FROM g JOIN f USING (gram)),
p AS (SELECT doc_id, n, gram FROM r WHERE k <= n - (4 * n + 4) // 5 + 1 AND df > 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM p x JOIN p y ON x.gram = y.gram AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * len(list_intersect(x.grams, y.grams)) >= 80 * (na + nb - len(list_intersect(x.grams, y.grams)))),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reached AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT s.doc_id, len(s.grams) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c USING (doc_id)
"""
