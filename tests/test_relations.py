"""Relations of files that grow: nothing is broadcast for its small files, nothing of a whole file is computed for each of its items."""

import time

from foliospark.sources import pdf, syntax
from foliospark.storage import relation
from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_relations_are_not_broadcast(spark):
    rows = spark.range(20_000).select("id", F.repeat(F.lit("repeated "), 200).alias("t"))
    a, b = relation(rows, "test-a"), relation(rows, "test-b")
    assert "Broadcast" not in _plan(a.where("id > 3").select("id").join(b.groupBy("id").agg(F.max("t")), "id"))
    assert a._folio_path and a.count() == 20_000


def test_values_are_computed_once_for_their_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "k int, t string")
    each = syntax.exploded(df, ["k"], syntax.every(F.col("t"), "[a-z]"), "i", "v")
    assert sorted(map(tuple, each.collect())) == [(1, 0, "a"), (1, 1, "b")]
    assert each._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_items_of_a_large_file_take_time_in_proportion(spark):
    body = "%PDF-1.7\n" + "".join(f"{i} 0 obj\n<< /Title (object {i}) /Parent 10 0 R /Dest [3 0 R /XYZ 0 {i} 0] >>\nendobj\n" for i in range(1, 8001))
    body += f"xref\n0 1\n0000000000 65535 f \ntrailer\n<< /Root 1 0 R >>\nstartxref\n{len(body)}\n%%EOF"
    files = spark.createDataFrame([(1, bytearray(body.encode()))], "doc_id long, content binary")
    began = time.time()
    found = pdf._items(files).where("num is not null").agg(F.count("*"), F.sum("num"), F.bool_and("sound"), F.max("at")).first()
    assert tuple(found) == (8000, 8000 * 8001 // 2, True, body.index("\n8000 0 obj") + 1)
    assert time.time() - began < 25  # 17 s for half as many items when a file was read again for each


def test_files_are_read_once(spark, tmp_path):
    """Sections are walked from the items: files that are costly to make are not made again for it."""
    made = spark.sparkContext.accumulator(0)

    def content(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    text = b"%PDF-1.7\n1 0 obj\n<< /Type /Catalog >>\nendobj\nxref\n1 1\n0000000009 00000 n \ntrailer\n<< /Root 1 0 R >>\nstartxref\n45\n%%EOF"
    files = spark.createDataFrame([(1, bytearray(text))], "doc_id long, content binary").mapInArrow(content, "doc_id long, content binary")
    assert sorted(r.num for r in pdf.objects(files).collect()) == [pdf.TRAILER, 1]
    assert made.value == 1


def test_coalesced_lines_are_those_of_a_plain_loop(spark):
    import random

    from foliospark.operators.relational import coalesce_lines

    r = random.Random(2)
    rows = [(r.choice([None, 1, 2]), i, r.choice([0.0, 5.0, 10.0, 40.0]), r.choice([100.0, 101.0, 103.0, 90.0]), r.choice([10.0, 12.0, 13.0, -1.0]), r.choice([3.0, 5.0]), r.choice(["x", " y", "z ", ""])) for i in range(600)]
    want, page, line = [], object(), None
    for p, _, x, baseline, height, width, text in sorted((v for v in rows if v[6]), key=lambda v: (v[0] or 0, v[1])):
        if line and p == page and abs(baseline - line[2]) <= height * 0.3 and abs(height - line[3]) <= line[3] * 0.25 and x >= end - height * 0.5:
            line[4] += (" " if x - end > height * 0.2 and not line[4].endswith(" ") and not text.startswith(" ") else "") + text
        else:
            line = [p, line[1] + 1 if line and p == page else 0, baseline, height, text]
            want.append(line)
        page, end = p, x + width
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = coalesce_lines(spark.createDataFrame(rows, "p int, ord int, x double, baseline double, height double, width double, text string"), ["p"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(repr, map(list, got))) == sorted(map(repr, want))
