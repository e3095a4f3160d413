"""Streams over small folders."""

from foliospark.streaming import ingest
from tests.pdf_maker import one_page


def test_files_of_a_folder_are_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in (1, 2):
        (tmp_path / "in" / f"{n}.pdf").write_bytes(one_page(f"BT /F1 9 Tf (page {n}) Tj ET".encode()))
    for _ in range(2):
        ingest.extract_stream(ingest.watch_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["page 1", "page 2"]


def test_search_stream(spark, tmp_path):
    spark.createDataFrame([(1, "An ant and AN AXE"), (2, "none")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    texts = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = ingest.search_stream(texts, "an").writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.doc_id, r.n_matches) for r in spark.table("found").collect()] == [(1, 4)]
