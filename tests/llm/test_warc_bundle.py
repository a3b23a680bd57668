import hashlib
import io

import duckdb
import zstandard

from quirefold.llm import queries, warc_bundle as W

DDL = "page_id long, url string, html string"


def _got(spark, rows):
    index = W.write_bundles(spark.createDataFrame(rows, DDL))
    return index, {(r["page_id"], r["payload_digest"]): r for r in W.read_bundles(index).collect()}


def test_revisits_refer_to_the_largest_page(spark):
    big, small = "x" * 1000, "y" * 999
    rows = [(1, "http://a", big), (7, "http://b", big), (3, None, big), (4, "http://c\r\nX: y", small), (5, "u", small), (6, "u", None), (None, "u", big)]
    index, got = _got(spark, rows)
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert len(got) == 7
    for page, _, html in rows:
        r = got[page, digest(html)]
        revisit = html == big and page != 7
        assert (r["payload_bytes"], r["record_type"], r["refers_to"]) == (len(html or ""), "revisit" if revisit else "response", 7 if revisit else None)
    headers, block = W.fetch(index, 4)
    assert headers["WARC-Record-ID"] == "<urn:x-page:4>" and block.endswith(small.encode()) and "\r" not in headers["WARC-Target-URI"]
    assert W.fetch(index, 99) is None


def test_frames_are_independent_and_the_index_points_into_them():
    out = io.BytesIO()
    writer = W.BundleWriter(out)
    records = [W.record(i, "http://x", (f"page {i} " * 3000).encode(), None) for i in range(120)]
    places = [writer.add(r) for r in records]
    writer.close()
    bundle = W.Bundle(io.BytesIO(out.getvalue()))
    assert len(bundle.places) > 2
    for raw, (frame, offset) in zip(records, places):
        assert bundle.frame(frame)[offset : offset + len(raw)] == raw
    # any decoder reads the whole file, passing over the seek table
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(records)


def test_repeated_rows_and_empty_tables(spark):
    big = "z" * 2000
    index = W.write_bundles(spark.createDataFrame([(2, "u", big), (2, "u", big), (1, "u", big), (1, "u", big)], DDL))
    rows = sorted((r["page_id"], r["record_type"]) for r in W.read_bundles(index).collect())
    assert rows == [(1, "revisit"), (1, "revisit"), (2, "response"), (2, "response")]
    empty = W.write_bundles(spark.createDataFrame([], DDL))
    assert empty.collect() == [] and W.read_bundles(empty).collect() == []


def test_the_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{sf_dir}/pages.parquet')")
    want = con.sql(queries.OP7_SQL)
    assert sorted((tuple(r) for r in queries.op7_warc(spark, sf_dir).select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
