"""Sharding by balanced label propagation; law ``rows``: counts at most one apart.

Documents with equal texts are linked. As linked documents of one text in one shard are
interchangeable, labels are propagated over the table (text, shard, count), which holds
no more than one row per text and shard, however many copies a text has. In each round
the copies that lie outside their text's fullest shards propose to move there; a shard
admits the share of the proposals that its quota and the moves out of it leave room for.
Only flows between shards, a row for each pair of shards, reach the driver. Rounds go on
until nothing is admitted, or ``PATIENCE`` of them in a row bring no more copies together,
as when shards that are nearly full trade the same copies.

Texts that are still cut then, though a shard could hold them, give up their places and are
laid out anew, largest first, along the room that is left, shard after shard. Only a text
across a limit between two shards stays out; there are fewer of these than shards, and each
goes where it fits best, or is cut if no shard has room for it whole. So fewer texts than
shards are cut that need not be. At last, ranks turn counts back into documents, and unlinked
documents fill each shard to its quota exactly. DataFrame operations only.

A text with more copies than a shard's quota moves towards as few shards as can hold it, but
is not laid out anew. Defined cases: a text of any length counts with all its bytes; null texts count as empty, and equal empty texts are linked; repeated rows are
separate copies; null ids are ranked first; an empty table gives no rows; fewer rows than
shards leave shards empty; further columns are ignored.
"""

from __future__ import annotations

from itertools import count as count_up

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from emrecon.llm.common import attach, buckets_for, cut, documents, ranked

#: A group's ranks are dealt to this many buckets at least.
GROUP_BUCKETS = 256
#: Rounds in which only texts with an eighth of a quota or more propose, while there is room.
LARGE_FIRST = 2
#: Rounds in a row without gain after which propagation ends.
PATIENCE = 3


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def _unit(*cols) -> Column:
    """A number in [0, 1) that depends on ``cols`` alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def admitted(loads: list[int], caps: list[int], flows: dict[tuple[int, int], int]) -> list[float]:
    """For each shard the share of the proposals to it that keeps it within its quota, if
    proposals elsewhere are admitted by the same shares."""
    n = len(caps)
    into = [sum(v for (_, b), v in flows.items() if b == s) for s in range(n)]
    share = [0.0] * n
    for _ in range(50):
        out = [0.0] * n
        for (a, b), v in flows.items():
            out[a] += v * share[b]
        share = [min(1.0, max(0.0, (caps[s] - loads[s] + out[s]) / into[s])) if into[s] else 0.0 for s in range(n)]
    return share


def _proposals(state: DataFrame, quota: int, closed: list[int], step: int) -> DataFrame:
    """text, total, shard, n, target: null where these copies stay. One row in for each
    text and shard, so a text's list has as many entries as there are shards at most."""
    last = F.array_contains(F.array(*map(F.lit, closed)), F.col("shard")) if closed else F.lit(False)
    entry = F.struct(last.alias("last"), (-F.col("n")).alias("less"), F.xxhash64("g", "shard").alias("tie"), "shard", "n")
    lists = state.groupBy("g").agg(F.sort_array(F.collect_list(entry)).alias("all"), F.sum("n").alias("total"))
    lists = lists.withColumn("m", F.least(F.ceil(F.col("total") / F.lit(max(1, quota))), F.size("all")).cast("int"))
    rows = lists.select("g", "total", "m", "all", F.posexplode("all").alias("at", "own"))
    target = F.element_at("all", F.pmod(F.xxhash64("g", F.col("own.shard"), F.lit(step)), F.col("m")).cast("int") + 1)["shard"]
    return rows.select("g", "total", "m", F.col("own.shard").alias("shard"), F.col("own.n").alias("n"), F.when(F.col("at") >= F.col("m"), target).alias("target"))


def cuts(state: DataFrame, quota: int) -> Row:
    """Of labels (g, shard, n): texts, those in more shards than need be (``cut``), links
    between copies (each pair once), and those across shards (``cut_links``)."""
    per = state.groupBy("g").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("shards"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    least = F.ceil(F.col("total") / F.lit(max(1, quota)))
    links = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(
        F.count(F.lit(1)).alias("texts"), F.count(F.when(F.col("shards") > least, 1)).alias("cut"),
        links(F.expr("(total * total - total) div 2")).alias("links"), links(F.expr("(total * total - squares) div 2")).alias("cut_links"),
    ).first()


def _apart(state: DataFrame) -> int:
    """Copies outside their text's fullest shard."""
    return state.groupBy("g").agg((F.sum("n") - F.max("n")).alias("n")).agg(F.sum("n")).first()[0] or 0


def _laid_out(loose: DataFrame, rooms: list[int], buckets: int) -> DataFrame:
    """(g, shard, n) for texts (g, total) that no shard holds yet, along the shards' rooms."""
    spark, bounds, room = loose.sparkSession, [], 0
    for r in rooms:
        room += r
        bounds.append(room)
    # larger texts have smaller buckets
    rows = loose.withColumn("b", (-F.col("total")) * buckets + F.pmod(F.xxhash64("g"), F.lit(buckets)))
    rows = ranked(rows, [], ["g"], "b", "before", "total")
    ends = F.array(*map(F.lit, bounds))
    shard = F.size(F.filter(ends, lambda x: x <= F.col("before"))).cast("int")
    rows = cut(rows.select("g", "total", "before", shard.alias("shard")), "line")
    fits = F.col("before") + F.col("total") <= F.element_at(ends, F.col("shard") + 1)
    placed = rows.where(fits).select("g", "shard", F.col("total").alias("n"))
    left = [*rooms]
    for r in placed.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # a row per shard
        left[r["shard"]] -= r["n"]
    more = []
    for r in rows.where(~fits).orderBy(F.desc("total"), "g").collect():  # fewer than shards
        whole = [s for s in range(len(left)) if left[s] >= r["total"]]
        n, takes = r["total"], [min(whole, key=lambda s: left[s])] if whole else sorted(range(len(left)), key=lambda s: -left[s])
        for s in takes:
            if own := min(n, left[s]):
                more.append((r["g"], s, own))
                left[s], n = left[s] - own, n - own
    return placed.unionByName(spark.createDataFrame(more, "g string, shard int, n long"))


def shard_by_labels(docs: DataFrame, shards: int = 40, report: list[Row] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; one row per row of ``docs``. ``report`` gets
    the ``cuts`` of the first labels and of the last."""
    text = F.col("text")
    base = cut(
        documents(docs).select(
            "doc_id", F.monotonically_increasing_id().alias("rid"), (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("g"),
        ),
        "sizes",
    )
    total = base.count()
    quota = total // shards
    caps = [quota + (s < total % shards) for s in range(shards)]

    counts = base.groupBy("g", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts, "counts")
    linked = counts.groupBy("g").agg(F.sum("n").alias("total")).where("total > 1").select("g")
    state = cut(counts.join(linked, "g"), "labels")

    def loads_of(df: DataFrame) -> list[int]:
        found = {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
        return [found.get(s, 0) for s in range(shards)]

    if report is not None:
        report.append(cuts(state, quota))
    loads, closed, least, idle = loads_of(state), [], None, 0
    for step in count_up():
        asked = _proposals(state, quota, closed, step)
        if step < LARGE_FIRST:
            asked = asked.withColumn("target", F.when(8 * F.col("total") >= quota, F.col("target")))
        flows = {(r["shard"], r["target"]): r["n"] for r in asked.where("target IS NOT NULL").groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}  # shards ** 2 rows at most
        if not flows and step >= LARGE_FIRST:
            break
        if not flows:
            continue
        share = admitted(loads, caps, flows)
        closed = [s for s in range(shards) if 0 < share[s] < 0.999 or (share[s] == 0 and any(b == s for _, b in flows))]
        p = _pick(share, F.col("target"))
        whole = F.when(_unit("g", "shard", F.lit(step)) < p, F.col("n")).otherwise(0)
        moved = asked.withColumn("moved", F.when(F.col("target").isNull(), 0).when(F.col("m") > 1, F.floor(F.col("n") * p)).otherwise(whole).cast("long"))
        parts = F.array(F.struct("shard", (F.col("n") - F.col("moved")).alias("n")), F.struct(F.coalesce("target", "shard").alias("shard"), F.col("moved").alias("n")))
        state = cut(moved.select("g", F.inline(parts)).where("n > 0").groupBy("g", "shard").agg(F.sum("n").alias("n")), "labels")
        loads, apart = loads_of(state), _apart(state)
        idle = 0 if least is None or apart < least else idle + 1
        least = apart if least is None else min(least, apart)
        if idle == PATIENCE:
            break

    if any(have > cap for have, cap in zip(loads, caps, strict=True)):
        # admission is a matter of chance for small groups: what exceeds a quota is taken out again
        order = state.withColumn("b", F.pmod(F.xxhash64("g"), F.lit(buckets_for(total, 20_000, 64))))
        order = ranked(order, ["shard"], ["n", "g"], "b", "before", "n")
        state = cut(order.select("g", "shard", F.greatest(F.lit(0), F.least("n", _pick(caps, F.col("shard")) - F.col("before"))).alias("n")).where("n > 0"), "labels")

    # what is cut and need not be is laid out anew
    totals = counts.groupBy("g").agg(F.sum("n").alias("total")).where((F.col("total") > 1) & (F.col("total") <= quota))
    held = state.groupBy("g").agg(F.sum("n").alias("labelled"), F.count(F.lit(1)).alias("shards"))
    loose = totals.join(held, "g", "left").where("labelled IS NULL OR labelled < total OR shards > 1").select("g", "total")
    loose = cut(loose, "loose")
    if not loose.isEmpty():
        whole = cut(state.join(loose, "g", "left_anti"), "labels")
        loads = loads_of(whole)
        anew = _laid_out(loose, [cap - have for have, cap in zip(loads, caps, strict=True)], buckets_for(total, 20_000, 16))
        state = cut(whole.unionByName(anew), "labels")
    loads = loads_of(state)
    if report is not None:
        report.append(cuts(state, quota))

    # counts back to documents: a text's shards take consecutive ranks
    pieces = state.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("p"), F.sum("n").alias("labelled"))
    upto = F.aggregate("p", F.array(F.struct(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("upto"))), lambda acc, x: F.concat(acc, F.array(F.struct(x["shard"].alias("shard"), (F.element_at(acc, -1)["upto"] + x["n"]).alias("upto")))))
    sizes = counts.groupBy("g").agg(F.sum("n").alias("total"))
    facts = cut(sizes.join(pieces.select("g", upto.alias("upto")), "g", "left"), "facts")
    rows = base.withColumn("b", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(buckets_for(total, 20_000, GROUP_BUCKETS))))
    labelled = attach(rows, facts, "g", "total", total)
    free = labelled.where("upto IS NULL").drop("upto", "total")
    tied = ranked(labelled.where("upto IS NOT NULL"), ["g"], ["doc_id", "rid"], "b", "rank")
    shard = F.element_at(F.filter("upto", lambda x: x["upto"] > F.col("rank")), 1)["shard"]
    tied = cut(tied.withColumn("shard", F.when(F.col("rank") < F.element_at("upto", -1)["upto"], shard)).drop("upto", "total", "rank"), "tied")
    free = free.unionByName(tied.where("shard IS NULL").drop("shard"))

    room, bounds = 0, []
    for s in range(shards):
        room += caps[s] - loads[s]
        bounds.append(room)
    rank = F.array(*map(F.lit, bounds))
    filled = ranked(free, [], ["doc_id", "rid"], "b", "rank")
    filled = filled.withColumn("shard", F.size(F.filter(rank, lambda x: x <= F.col("rank"))).cast("int")).drop("rank")
    placed = cut(filled.unionByName(tied.where("shard IS NOT NULL")), "placed")
    placed = placed.withColumn("b", F.pmod(F.xxhash64("rid"), F.lit(buckets_for(total, 20_000 * shards, 64))))
    return ranked(placed, ["shard"], ["doc_id", "rid"], "b", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_labels(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
