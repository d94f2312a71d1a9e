"""The pipeline's stages against what they leave."""

from tests.llm.test_jaccard import brute, shingles
from tests.llm.test_text import check_packing, pieces_of

import corpus_pipeline
from emrecon.llm.common import cut

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        left[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
    ids = {k: {r.doc_id for r in v} for k, v in left.items()}
    known = [i for i in ids["toxicity"] if i in labels]
    assert sum(labels[i].toxic for i in known) <= 0.05 * len(known)
    clean = [i for i in labels if not labels[i].toxic]
    assert len([i for i in clean if i in ids["toxicity"]]) >= 0.98 * len(clean)
    texts = [r.text for r in left["exact_dedup"]]
    assert len({" ".join(t.split()) for t in texts}) >= len(texts) - 1
    assert {" ".join(r.text.split()) for r in left["quality_rules"]} == {" ".join(t.split()) for t in texts}
    classes = brute([(r.doc_id, r.text) for r in left["exact_dedup"]], 5, 80)
    assert ids["ngram_jaccard_join"] == {i for i, (_, c) in classes.items() if c == i}
    assert all(shingles(r.text, 5) for r in left["ngram_jaccard_join"])
    check_packing(left["best_fit_packing"])
    want = pieces_of([(r.doc_id, r.text) for r in left["ngram_jaccard_join"]])
    got = {}
    for r in left["best_fit_packing"]:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_odd_rows(spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            rows = cut(stage(spark, rows, str(tmp_path)), name)
        # no labels: nothing is known to be toxic, and base rules decide on quality
        assert {r.doc_id for r in rows.collect()} == ({6} if docs is odd else set())
