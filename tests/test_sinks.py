"""CSV output, append-only tables, catalogue paging."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.catalogue import Cursor, fetch_page, global_search, page_size
from tidewatch.operators.search import SearchIndex
from tidewatch.sinks import reports


def test_csv_files_start_with_a_header(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x"), (2, "a,b")], "id int, name string")
    reports.write_csv(df, str(tmp_path / "csv"), single_file=True)
    part = next((tmp_path / "csv").glob("part-*.txt"))
    assert part.read_bytes() == b'id,name\r\n1,\'=x\r\n2,"a,b"\r\n'
    reports.write_csv(df.repartition(2, "id"), str(tmp_path / "parts"))
    def whole(name):
        return b"".join(f.read_bytes() for f in sorted((tmp_path / name).glob("part-*.txt")))

    assert whole("parts").startswith(b"id,name\r\n") and whole("parts").count(b"id,name") == 1
    for single in (True, False):
        reports.write_csv(df.limit(0), str(tmp_path / f"empty-{single}"), single_file=single)
        assert whole(f"empty-{single}") == b"id,name\r\n"
    assert reports.csv_document(df) == "id,name\r\n1,'=x\r\n2,\"a,b\""


def test_download_refuses_too_many_rows(spark):
    with pytest.raises(reports.TooLarge):
        reports.csv_document(spark.range(30).toDF("id"), limit=20)


def test_search_index(spark, tmp_path):
    rows = [("1", "Villa Añil", "http://a.example/xyz"), ("2", "villa", None), ("2", "villa", None),
            ("3", None, "VILLA"), (None, "Casa  villa", ""), ("4", "vi", "lla"), ("5", "abcabcabc", "")]
    rows += [(str(k), f"common name {k}", f"http://common.example/{k}") for k in range(10, 200)]
    people = spark.createDataFrame([(1, "Anna Villa"), (2, "")], "n int, name string")
    tables = {"place": (spark.createDataFrame(rows, "id string, title string, url string"), "id", ["title", "url"]),
              "person": (people, "n", ["name"])}
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=4).build(**tables)
    for needle in ("villa", "VILLA", "lla", "ñil", "vi", "", "abcabc", "cabcab", "name 10", "common", "nothing at all", "xy"):
        got = sorted(map(tuple, index.find(needle).collect()), key=repr)
        assert got == sorted(map(tuple, global_search(needle, **tables).collect()), key=repr), needle
    # Far fewer texts are tested than there are rows.
    assert index.candidates("name 10").count() <= 20 and index.candidates("no such thing").count() == 0


def test_pages_cover_all_rows_once(spark):
    df = spark.range(57).select(F.col("id"), (F.col("id") % 10).cast("string").alias("s"))
    seen, cursor = [], None
    while True:
        page, cursor = fetch_page(df, "s", "id", 20, cursor)
        seen += [r.id for r in page]
        if cursor is None:
            break
    assert sorted(seen) == list(range(57))
    assert (page_size(None), page_size(0), page_size(1000), page_size(2.9)) == (25, 1, 100, 2)


def test_malformed_cursor():
    for bad in ("%%%", "bm90IGpzb24", Cursor("a", "b").encode()[:-6]):
        with pytest.raises(ValueError):
            Cursor.decode(bad)
    assert Cursor.decode(Cursor("2024", "7").encode()) == Cursor("2024", "7")


def test_output_record(spark):
    row = reports.output_record(spark, "o1", 12).head()
    assert (row.row_count, row.status) == (12, "ready")
    assert (row.expires_at - row.ready_at).days == 7
