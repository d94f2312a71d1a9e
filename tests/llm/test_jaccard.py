"""N-gram Jaccard join against brute force."""

import random

import numpy as np
import pytest
from tests.support import DATA, same

from emrecon.llm import jaccard_join as J
from emrecon.llm.components import connected


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, t):
    """(doc_id, set size) -> component, for rows with distinct ids."""
    sets = {i: shingles(x, k) for i, x in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = len(sets[i]), len(sets[j])
            if 100 * a < t * b:
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= t * (a + b - both):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = result(J.op4_ngram_jaccard_join(spark, DATA))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 90)


def corpus(seed, n=260):
    """Chains and bundles of copies around the limit, shared passages, short texts."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    passage = rng.choices(vocab, k=40)
    bases = [rng.choices(vocab, k=rng.choice([2, 3, 5, 12, 40, 120])) for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases)) if rng.random() < 0.8 else rng.choices(vocab, k=rng.randrange(0, 60))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocab)
        if rng.random() < 0.2:
            words += passage
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("k", "t", "leaf"), [(3, 90, 128), (2, 80, 4), (5, 80, 16)])
def test_random_corpora(docs_of, monkeypatch, k, t, leaf):
    monkeypatch.setattr(J, "LEAF", leaf)
    rows = corpus(k * t)
    assert result(J.jaccard_components(docs_of(rows), k, t)) == brute(rows, k, t)


def test_joined_instead_of_broadcast(docs_of, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_IDS", 0)
    rows = corpus(1, 80)
    assert result(J.jaccard_components(docs_of(rows), 3, 80)) == brute(rows, 3, 80)


def test_odd_rows(odd, none):
    rows = J.jaccard_components(odd, 3, 90).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i in (1, 2, 3):
        assert (by[i][0].n_shingles, by[i][0].component_id) == (0, i)
    assert by[4][0].n_shingles == by[5][0].n_shingles == by[12][0].n_shingles == 1
    assert [r.component_id for r in by[7]] == [7, 7] and by[10][0].component_id == by[11][0].component_id == 7
    assert by[8][0].component_id == 6 and by[6][0].n_shingles > 9000
    assert by[None][0].component_id is None
    assert J.jaccard_components(none, 3, 90).count() == 0
    kept = J.keep_one(odd, 5, 80)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 6, 7, 9, 12, None}


def test_trees_prune_soundly():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(40, 61)], rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(50)]
    j = J.Join(sets, list(range(50)), 80)
    root = j.tree(list(range(50)))
    j.traverse(root, root)
    up = list(range(50))
    find = lambda i: i if up[i] == i else find(up[i])
    for a in range(50):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    groups = lambda f: {frozenset(i for i in range(50) if f(i) == f(k)) for k in range(50)}
    assert groups(j.find) == groups(find)


def test_components_of_a_path(spark):
    edges = spark.range(200).selectExpr("(id * 37) % 200 AS x").selectExpr("x AS a", "x + 1 AS b")
    got = {r.node: r.comp for r in connected(edges).collect()}
    assert got == {i: 0 for i in range(201)}
    assert connected(edges.where("false")).count() == 0


@pytest.mark.parametrize("n", [3000])
def test_components_of_long_shuffled_paths(spark, n):
    ids = list(range(2 * n))
    random.Random(n).shuffle(ids)
    paths = [ids[:n], ids[n:]]
    edges = spark.createDataFrame([(int(a), int(b)) for p in paths for a, b in zip(p, p[1:])], "a long, b long")
    got = {r.node: r.comp for r in connected(edges).collect()}
    assert got == {i: min(p) for p in paths for i in p}


def alike(n, length, passage, seed):
    """Texts that share a passage and are not linked, and a few copies with a word changed."""
    rng = random.Random(seed)
    own = [f"p{i}" for i in range(passage)]
    rows = [(i, " ".join(own + [f"x{rng.randrange(10**9)}" for _ in range(length - passage)])) for i in range(n)]
    for k in range(12):
        words = rows[k * 7][1].split()
        words[-1] = "changed"
        rows.append((n + k, " ".join(words)))
    return rows


@pytest.mark.parametrize(("length", "passage"), [(300, 190), (70, 61)])
def test_visitors_come_in_blocks(docs_of, monkeypatch, length, passage):
    leaf, visitors = 8, J.join_visitors

    def watched(pdf, percent):
        assert len(pdf) <= 6 * leaf, f"{len(pdf)} rows in a group"
        return visitors(pdf, percent)

    monkeypatch.setattr(J, "LEAF", leaf)
    monkeypatch.setattr(J, "join_visitors", watched)
    rows = alike(300, length, passage, 5)
    assert result(J.jaccard_components(docs_of(rows), 3, 80)) == brute(rows, 3, 80)


def test_trees_have_levels_and_prune(spark, docs_of, monkeypatch):
    """Documents of the table, each with copies that are cut short and have some words
    changed: the trees of their clusters have several levels, and the traversal cuts node
    pairs off."""
    monkeypatch.setattr(J, "LEAF", 8)
    monkeypatch.setattr(J, "FAN", 2)
    rng, rows = random.Random(7), []
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect() if 60 <= len(r.text.split()) <= 120][:6]
    for text in texts:
        for k in range(40):
            words = text.split()
            words = words[: len(words) * (60 + k) // 100]
            for at in rng.sample(range(len(words)), rng.choice([1, 2, 3, 4])):
                words[at] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    seen, levels_of, traversed = {}, J.tree_levels, J.traversed

    def levels(crowd):
        seen["levels"] = levels_of(crowd)
        return seen["levels"]

    def pairs(own, percent):
        left = traversed(own, percent)
        ids = own[1].groupBy("cluster").count().collect()
        seen["all"], seen["left"] = sum(r["count"] * (r["count"] - 1) // 2 for r in ids), left.count()
        return left

    monkeypatch.setattr(J, "tree_levels", levels)
    monkeypatch.setattr(J, "traversed", pairs)
    assert result(J.jaccard_components(docs_of(rows), 3, 80)) == brute(rows, 3, 80)
    assert len(seen["levels"]) >= 4 and seen["left"] < seen["all"]


def test_equal_sets_alone(docs_of):
    rows = corpus(3, 60) + [(100, "a b c d"), (101, "A  b c D"), (102, "a b c e")]
    assert result(J.jaccard_components(docs_of(rows), 3, 100)) == brute(rows, 3, 100)
    with pytest.raises(ValueError):
        J.jaccard_components(docs_of(rows), 3, 0)


def test_keep_one_of_repeated_and_null_ids(docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w59", "v")
    rows = [(5, text), (5, near), (5, text), (None, text + " x"), (None, "alone " * 9), (7, near), (8, "other words here " + near[:20])]
    kept = J.keep_one(docs_of(rows), 5, 80).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 5, 8]


def test_query_equals_sql(spark, duck):
    same(J.op4_ngram_jaccard_join(spark, DATA).toPandas(), duck.sql(J.ORACLE).df())


def test_sql_of_odd_rows(spark, odd):
    """The SQL takes nulls, blanks and short texts as the operator does."""
    import duckdb

    rows = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text")
    documents = rows.toPandas()
    c = duckdb.connect()
    c.register("documents", documents)
    same(J.jaccard_components(rows, 3, 90).toPandas(), c.sql(J.ORACLE).df())


def test_rows_without_ids_are_linear(docs_of, monkeypatch):
    """Of near copies without ids, each text meets its own members only."""
    base = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join([*base[: k % 60], f"z{k}", *base[k % 60 + 1 :]])) for k in range(150)] + [(None, "the same text " * 9)] * 80
    docs, met = docs_of(rows), []
    table = J.gram_table

    def counted(docs, members, count, words):
        out = table(docs, members, count, words)
        met.append((members.count(), out.count()))
        return out

    monkeypatch.setattr(J, "gram_table", counted)
    got = J.jaccard_components(docs, 3, 80).collect()
    assert len(got) == 230
    assert all(out == members for members, out in met) and met


def test_trees_prune_on_documents(spark):
    """Unpatched, on given documents: pairs of tree nodes that the dual traversal met and cut off."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    hashes = J.Hashes()
    classes = brute([(r.doc_id, r.text) for r in docs], 3, 60)  # as clusters: wider than the limit
    groups = {}
    for r in docs:
        groups.setdefault(classes[r.doc_id][1], []).append(hashes(r.text or "", 3))
    visited = pruned = 0
    for sets in groups.values():
        distinct = [*{s.tobytes(): s for s in sets if len(s)}.values()]
        if len(distinct) > 2:
            j = J.Join(distinct, [*range(len(distinct))], 90)
            root = j.tree([*range(len(distinct))])
            j.traverse(root, root)
            visited, pruned = visited + j.visited, pruned + j.pruned
    assert 0 < pruned < visited


def test_shared_ngrams_by_class_of_size(spark):
    from emrecon.llm.jaccard_join import met

    grams = spark.createDataFrame([(1, 50, 7, 11), (2, 55, 8, 11), (3, 70, 9, 11), (3, 70, 9, 12)], "node long, n long, size long, h long")
    shared = spark.createDataFrame([(11, 7, 2), (11, 8, 2), (13, 9, 5)], "h long, size long, nodes long")
    got = met(grams, shared)
    assert sorted(map(tuple, got.collect())) == [(1, 50, 4, 11, 7), (2, 55, 4, 11, 7), (2, 55, 4, 11, 8), (3, 70, 4, 11, 8)]


@pytest.mark.parametrize("t", [90, 97])
def test_linked_sets_share_a_key_by_parts(t):
    """Sets as unlike as the limit allows, of all sizes, with and without weak ranges."""
    rng, parts, met = np.random.default_rng(t), J.Parts(t), 0
    for k in range(1500):
        n = int(rng.integers(8, 60) if k % 2 else rng.integers(60, 700))
        m = int(rng.integers(-(-n * t // 100), n * 100 // t + 1))
        both = -(-t * (n + m) // (100 + t))
        if both > min(n, m) or both == n == m:
            continue
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.concatenate([rng.choice(a, both, replace=False), rng.integers(0, 2**64, m - both, dtype=np.uint64)])
        assert len(np.intersect1d(parts(np.unique(a)), parts(np.unique(b))))
        met += 1
    assert met > 500


def test_keys_occur_once_a_batch():
    keys = [np.array(k, np.int64) for k in ([1, 2], [2, 3], [], [1, 2, 3])]
    first, near = J.once(keys, np.array([10, 11, 12, 13]))
    assert [k.tolist() for k in first] == [[1, 2], [3], [], []]
    assert [k.tolist() for k in near] == [[], [10], [], [10, 11]]
    assert J.once([], np.zeros(0, np.int64)) == ([], [])


@pytest.mark.parametrize(("k", "t", "leaf"), [(3, 90, 4), (1, 90, 16), (2, 95, 4)])
def test_random_corpora_by_parts(docs_of, monkeypatch, k, t, leaf):
    monkeypatch.setattr(J, "LEAF", leaf)
    rows = corpus(k + t)
    assert result(J.jaccard_components(docs_of(rows), k, t)) == brute(rows, k, t)


def test_ngrams_in_common_by_chance_make_no_members(docs_of, monkeypatch):
    """However many documents have an n-gram, only near copies and hardly any others are compared."""
    rng, seen = random.Random(4), []
    rows = [(i, " ".join(rng.choices("abcdefghijkl", k=150))) for i in range(300)]
    rows += [(300 + i, f"{rows[i][1]} changed") for i in range(10)]
    components = J.cluster_components

    def counted(docs, nodes, clusters, words, percent):
        seen.append(clusters.count())
        return components(docs, nodes, clusters, words, percent)

    monkeypatch.setattr(J, "cluster_components", counted)
    assert result(J.jaccard_components(docs_of(rows), 3, 90)) == brute(rows, 3, 90)
    assert 20 <= seen[0] <= 40


def test_only_members_texts_are_shuffled(docs_of, monkeypatch, capsys):
    """Too many members for a broadcast: their texts are found by numbers, in turns."""
    monkeypatch.setattr(J, "BROADCAST_IDS", 0)
    monkeypatch.setattr(J, "BROADCAST_KEYS", 40)
    found = J.members_texts

    def planned(docs, members, count):
        out = found(docs, members, count)
        out.explain()
        return out

    monkeypatch.setattr(J, "members_texts", planned)
    rows = corpus(2, 120) + [(None, "of the same kind " * 9)] * 3
    got = J.jaccard_components(docs_of(rows), 3, 90).collect()
    ids = brute(rows[:120], 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == ids and len(got) == 123
    assert "LeftSemi" in capsys.readouterr().out
