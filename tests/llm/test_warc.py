import io
import struct

import pytest
import zstandard

from strandlake.llm import warc as W


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    big = "<p>" + "same payload " * 200
    rows = [(i, f"http://a.example.org/{i}", f"<html>page {i} {'x' * i * 7}") for i in range(60)]
    rows += [(100, "http://b/", big), (101, None, big), (102, "bad url\n\u0001", big), (102, "again", big), (103, "http://c/", None), (104, "", ""), (None, "http://n/", big), (105, "http://s/", "short"), (106, "http://s/", "short")]
    path = str(tmp_path_factory.mktemp("warc") / "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS tag", "2 AS digest", "3 AS n").write.parquet(path)
    return spark.read.parquet(path)


def test_round_trip(spark, pages):
    got = W.archive_round_trip(pages).collect()
    assert len(got) == pages.count()
    same = [r for r in got if r.payload_bytes == 2603]
    assert sorted(r.record_type for r in same) == ["response"] + ["revisit"] * 4
    assert [r.page_id for r in same if r.record_type == "response"] == [102] and {r.refers_to for r in same if r.record_type == "revisit"} == {102}
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.payload_bytes < 1000)
    assert W.archive_round_trip(pages.limit(0)).count() == 0


def test_archives_roll_and_carry_the_dictionary(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_ROWS", 16)
    path = f"file://{tmp_path}/archives"
    W.write_archives(pages, path)
    files = [f for f in (tmp_path / "archives").iterdir() if f.name.startswith("part-") and f.stat().st_size]
    assert len(files) > 3
    for f in files:
        raw = f.read_bytes()
        magic, size = struct.unpack_from("<II", raw)
        assert magic == W.DICTIONARY_MAGIC and raw[8:12] == b"\x37\xa4\x30\xec"
        frame = raw[8 + size + 8 :]
        with pytest.raises(zstandard.ZstdError):
            zstandard.ZstdDecompressor().decompress(frame)
    assert W.read_archives(spark, path).count() == pages.count()


def test_records_parse_back():
    raw = W.record(7, 1, "http://x/a b", b"payload\r\n\r\nmore", None) + W.record(None, 2, None, b"p", (7, 1))
    (h1, b1), (h2, b2) = W.read_records(io.BytesIO(raw))
    assert h1["warc-type"] == "response" and b1.endswith(b"payload\r\n\r\nmore") and h1["warc-target-uri"] == "http://x/a%20b"
    assert h2["warc-refers-to"] == h1["warc-record-id"] and "x-page-id" not in h2 and b2.endswith(b"\r\n\r\n")


def test_archives_end_at_their_bytes(spark, pages, tmp_path, monkeypatch):
    """A payload beyond an archive's bytes gets an archive of its own, and all records read back."""
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 2000)
    path = f"file://{tmp_path}/small"
    W.write_archives(pages.coalesce(1), path)
    files = [f for f in (tmp_path / "small").iterdir() if f.name.startswith("part-") and f.stat().st_size]
    assert len(files) > 5
    got = sorted((str(r.page_id), r.payload_bytes) for r in W.read_archives(spark, path).collect())
    assert got == sorted((str(r.page_id), len((r.html or "").encode())) for r in pages.collect())
