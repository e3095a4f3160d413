"""The pipeline's stages against plain versions."""

import hashlib
from collections import Counter

import corpus_pipeline as cp
from foliospark.llm import quality
from tests.llm.test_near_copies import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in cp.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]

    kept = cp.quality(spark, docs, sf_dir)
    model = quality.fit_ranking(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if quality.score_rows(__import__("numpy").array([quality.features(r.text)], float), model)[0] >= 0.7}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == want and 0 < len(want) < docs.count()

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders: dict[str, set] = {}
    for d, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(d)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    plain = {d: "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d) for d, t in rows}
    cut = cp.lines(spark, kept, sf_dir)
    assert cut.columns == columns and {r.doc_id: r.text for r in cut.collect()} == plain
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    one = cp.near(spark, cut, sf_dir)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == set(brute(list(plain.items())).values())

    clean = cp.decontaminate(spark, one, sf_dir)
    assert clean.columns == columns and 0 < clean.count() < one.count()
    pieces = cp.packing(spark, clean, sf_dir).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in clean.collect()}
    assert all(sum(p.length for p in pieces if p.doc_id == d) == n for d, n in Counter({p.doc_id: p.doc_tokens for p in pieces}).items())


def test_run_is_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    pieces = lambda df: Counter(hashlib.md5(repr((r.doc_id, r.start, r.length, r.ids_crc32)).encode()).hexdigest() for r in df.collect())
    ran, staged_ = cp.run(spark, sf_dir), docs
    total = lambda df: Counter({r.doc_id: r.doc_tokens for r in df.collect()})
    assert total(ran) == total(staged_)
    # which pieces a document is cut into depends on the task that packs it; its ids don't
    whole = lambda df: {r.doc_id: r.ids_crc32 for r in df.collect() if r.length == r.doc_tokens}
    a, b = whole(ran), whole(staged_)
    assert len(a.keys() & b.keys()) > len(total(ran)) / 3 and all(a[d] == b[d] for d in a.keys() & b.keys())
    assert pieces(cp.run(spark, sf_dir)).keys() == pieces(ran).keys()


def test_quality_keeps_all_where_nothing_was_learned(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a text"), (2, None), (3, "another text")], "doc_id long, text string")
    for name, labels in (("none", []), ("good", [(1, 1, 0), (3, 1, 0)])):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert sorted(cp.quality(spark, docs, f"{tmp_path}/{name}").collect()) == sorted(docs.collect())


AWKWARD = [
    (1, None), (2, ""), (None, "a line that is long enough to count\nx"), (None, None), (3, " ".join(f"word{i}" for i in range(20_000))), (4, "a line that is long enough to count"), (4, "a line that is long enough to count"), (5, "A LINE that is long enough to count \nmore"),
    (6, "a line that is long enough to count"), (7, " " * 600_000), (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (9, "é\U0001f600" * 40),
]


def test_stages_on_awkward_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    clash = ["n_lines", "row", "h1", "k", "__k", "component", "node", "score", "predicted", "hit", "ids", "n_words", "start", "label", "of", "a"]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long")
    for c in clash:
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(7))
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (99, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = cp.quality(spark, docs, str(tmp_path))
    assert kept.count() == len(AWKWARD) and kept.columns == docs.columns
    cut = cp.lines(spark, kept, str(tmp_path))
    assert cut.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text) for r in cut.collect() if r.doc_id in (None, 1, 4, 5, 6)) == [(0, ""), (0, AWKWARD[2][1]), (1, ""), (4, ""), (4, ""), (5, "more"), (6, AWKWARD[4 + 4][1])]
    one = cp.near(spark, cut, str(tmp_path))
    assert one.columns == docs.columns and sorted((r.doc_id or 0) for r in one.collect()) == [1, 3, 5, 6, 8, 9]  # the line with one more word is a copy of document 6
    clean = cp.decontaminate(spark, one, str(tmp_path))
    assert clean.columns == docs.columns and sorted((r.doc_id or 0) for r in clean.collect()) == [1, 3, 5, 6, 9]
    pieces = cp.packing(spark, clean, str(tmp_path)).collect()
    assert Counter((p.doc_id or 0) for p in pieces if p.start == 0) == Counter([1, 3, 5, 6, 9])
    assert all(sum(p.length for p in pieces if p.doc_id == q.doc_id) == q.doc_tokens for q in pieces)


def test_run_on_empty_tables_leaves_no_tables(spark, tmp_path):
    import os

    from foliospark.storage import shared_dir

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    place = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(place))
    assert cp.run(spark, str(tmp_path)).collect() == []
    assert len(set(os.listdir(place)) - before) == 1
