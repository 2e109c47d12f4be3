import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from segmill.llm import warc

PAGES = "page_id long, url string, html string, digest string, file string, n long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGES)


ROWS = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (7, "http://c", "same"), (3, "http://d", None), (4, "http://e", ""), (5, "http://f", "ünï\r\n\r\nWARC/1.1\r\n" * 9), (6, "http://g", "z" * 300_000), (6, "http://g", "z" * 300_000)]


def test_round_trip(spark, tmp_path):
    index = warc.write_archives(pages(spark, ROWS), f"file://{tmp_path}/w")
    assert index.count() == len(ROWS)
    got = warc.read_records(index)
    seen = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect())
    want = []
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        largest = max(p for p, _, h in ROWS if (h or "") == (html or ""))
        want.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if page_id < largest else "response", largest if page_id < largest else None))
    assert seen == sorted(want)
    assert {r.url for r in got.where("page_id = 1").collect()} == {"http://a/%0D%0AX: y"}


def test_files_are_gzip_members_of_records(spark, tmp_path):
    index = warc.write_archives(pages(spark, ROWS[:3]), f"file://{tmp_path}/w").collect()
    for row in index:
        data = Path(row.file.removeprefix("file://")).read_bytes()
        headers, block = warc.parse_record(gzip.decompress(data[row.offset : row.offset + row.length]))
        assert headers["page-id"] == str(row.page_id) and headers["warc-type"] == row.record_type
        if row.record_type == "revisit":
            assert headers["warc-refers-to"] == f"<urn:page:7:{row.digest}>" and headers["refers-to-page-id"] == "7"
        assert block.endswith(b"same") == (row.record_type == "response")
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_small_payloads_are_responses(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    got = {r.page_id: r.refers_to for r in warc.archive_pages(pages(spark, rows), min_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_selected_records_only(spark, tmp_path):
    index = warc.write_archives(pages(spark, [(i, f"u{i}", str(i) * 1000) for i in range(50)]), f"file://{tmp_path}/w")
    assert {r.page_id for r in warc.read_records(index.where("page_id % 7 = 0")).collect()} == set(range(0, 50, 7))


def test_null_id_and_empty(spark):
    (row,) = warc.archive_pages(pages(spark, [(None, "u", "a")])).collect()
    assert (row.page_id, row.record_type) == (None, "response")
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_damage_is_found(spark, tmp_path):
    index = warc.write_archives(pages(spark, [(1, "u", "payload")]), f"file://{tmp_path}/w")
    (row,) = index.collect()
    record = gzip.decompress(Path(row.file.removeprefix("file://")).read_bytes()[row.offset : row.offset + row.length])
    bad = gzip.compress(record.replace(b"payload\r\n", b"paYload\r\n"))
    (tmp_path / "bad").write_bytes(bad)
    broken = spark.createDataFrame([(f"file://{tmp_path}/bad", 0, len(bad))], "file string, offset long, length long")
    with pytest.raises(Exception, match="is damaged"):
        warc.read_records(broken).collect()


def test_record_ids_are_unique(spark, tmp_path):
    rows = [*ROWS, (None, "u", "q"), (None, "u", "q"), (7, "v", "other"), (8, "w", "top"), (8, "w", "top"), (2, "w", "top"), (2, "w", "top"), (9, "x", ""), (9, "x", None)]
    index = warc.write_archives(pages(spark, rows), f"file://{tmp_path}/w").collect()
    ids, refers = [], []
    for row in index:
        data = Path(row.file.removeprefix("file://")).read_bytes()[row.offset : row.offset + row.length]
        headers, _ = warc.parse_record(gzip.decompress(data))
        ids.append(headers["warc-record-id"])
        refers.append(headers.get("warc-refers-to"))
    assert len(ids) == len(set(ids)) == len(rows) and {r for r in refers if r} <= set(ids)
    got = sorted((r.page_id, r.refers_to) for r in warc.read_records(spark.createDataFrame(index)).where("page_id in (2, 8)").collect())
    assert sorted(got, key=str) == sorted([(2, 7), (2, 8), (2, 8), (8, None), (8, None)], key=str)


def test_read_back_is_in_parallel(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 4000)
    rows = [(i, f"u{i}", "".join(hashlib.sha1(f"{i} {k}".encode()).hexdigest() for k in range(25))) for i in range(60)]
    index = warc.write_archives(pages(spark, rows), f"file://{tmp_path}/w")
    total = index.agg({"length": "sum"}).first()[0]
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and total > 8 * 4000
    found = warc.read_records(index)
    assert found.rdd.getNumPartitions() >= total // 4000 and found.count() == 60

