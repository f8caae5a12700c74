import io
import zlib

import duckdb
import pytest
from llm_helpers import SF, TEXTS

from terralake.llm import warc
from terralake.llm.common import folder
from terralake.llm.registry import QUERIES, SQL


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    wanted = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr) == sorted(wanted, key=repr) and wanted


def test_query_equals_sql(spark, documents):
    assert same_as_sql(spark, "op2_warc")


def test_round_trip_of_odd_rows(spark, documents):
    pages = [(i, f"http://x/{k}\r\nWARC-Type: evil", t) for k, (i, t) in enumerate(TEXTS)] + [(9, None, "word " * 30_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    written = warc.write_archives(frame, folder(spark, "odd"))
    rows = warc.read_archives(written, payloads=True).collect()
    assert len(rows) == len(pages) == sum(r["records"] for r in written.collect())
    kinds = {}
    for r in rows:
        kinds.setdefault((r["payload_bytes"], r["payload_digest"]), []).append((r["record_id"], r["record_type"], r["refers_to"]))
    # Empty payloads: of ids 2 and 3 the larger is the response, and so is none without an id.
    empty = kinds[0, warc.digest(__import__("hashlib").sha1(b""))]
    assert sorted(empty) == [("<urn:page:2>", "revisit", "<urn:page:3>"), ("<urn:page:3>", "response", None), ("<urn:page:>", "revisit", "<urn:page:3>")]
    # Repeated rows of the largest id are responses both.
    assert sum(r["record_type"] == "response" for r in rows if r["record_id"] == "<urn:page:1>") == 2
    texts = {(t or "").encode() for _, t in TEXTS}
    assert {bytes(r["payload"]) for r in rows if r["payload"] is not None} == texts
    assert all("\r" not in (r["target_uri"] or "") for r in rows)


def test_smaller_payloads_are_all_responses(spark, documents):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    found = {r["record_id"]: r["record_type"] for r in warc.read_archives(warc.write_archives(frame, folder(spark, "least"), least=3)).collect()}
    assert found == {"<urn:page:1>": "response", "<urn:page:2>": "response", "<urn:page:3>": "revisit", "<urn:page:4>": "response"}


def test_empty_table(spark, documents):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(frame, folder(spark, "none"))).collect() == []


def test_any_chunk_size_gives_the_same_records():
    archive = b"".join(warc._record(k, f"http://x/{k}", b"line\r\n\r\n" * k * 50, None if k % 2 else 7, k % 2 == 0) for k in range(6))
    wanted = list(warc.records(io.BytesIO(archive), keep=True))
    assert [r[4] for r in wanted] == [400 * k for k in range(6)] and [r[1] for r in wanted] == ["revisit", "response"] * 3
    for chunk in (1, 7, 100, 4096):
        assert list(warc.records(io.BytesIO(archive), keep=True, chunk=chunk)) == wanted


@pytest.mark.parametrize("broken", ["cut", "garbage", "digest", "length", "not warc"])
def test_broken_archives_are_told(broken):
    good = warc._record(1, "u", b"payload", None, False)
    plain = zlib.decompress(good, 31)
    pack = lambda b: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + z.flush()
    data = {
        "cut": good[:-9],
        "garbage": good + b"not gzip",
        "digest": pack(plain.replace(b"payload\r\n", b"PAYLOAD\r\n")),
        "length": pack(plain + b"more"),
        "not warc": pack(b"HTTP/1.1 200 OK\r\n\r\n"),
    }[broken]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(io.BytesIO(data)))


def test_a_broken_archive_fails_the_job_with_its_name(spark, documents, tmp_path):
    (tmp_path / "bad.warc.gz").write_bytes(warc._record(1, "u", b"payload", None, False)[:-5])
    with pytest.raises(Exception, match="bad.warc.gz"):
        warc.read_archives(spark.createDataFrame([(str(tmp_path / "bad.warc.gz"),)], "path string")).collect()
