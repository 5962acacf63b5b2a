import gzip
import hashlib
import io

import pytest

from risekit.llm import warc


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, tmp_path, compress):
    big = "x" * 1000 + "WARC/1.1\r\n\r\n\r\nContent-Length: 5\r\n" + "é" * 2000
    rows = [(1, "http://a/1", "short"), (2, "http://a/2", "short"), (3, "http://b", big), (9, "http://c", big), (5, None, big), (4, "u", None), (6, "u\r\nX: y%0A", ""), (None, "n", "z" * 200), (None, "n", "z" * 200), (7, "d", "z" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/out", chunk_bytes=700, compress=compress)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    table = warc.read_archives(spark, manifest, chunk_bytes=700).collect()
    last = sorted(((r["page_id"], r["url"], r["bytes_so_far"], r["digest_so_far"], r["record_type"], r["refers_to"]) for r in table if r["is_last"]), key=str)
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if j is not None and (g or "").encode() == raw]
        visit = len(raw) >= 100 and len([1 for _, _, g in rows if g == h]) > 1 and i != min(same)
        want.append((i, u, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if visit else "response", min(same) if visit else None))
    assert last == sorted(want, key=str)
    chunks = sorted((r["chunk_no"], bytes(r["data"]), r["digest_so_far"]) for r in table if r["page_id"] == 3)
    assert len(chunks) > 3 and max(len(d) for _, d, _ in chunks) <= 700
    assert b"".join(d for _, d, _ in chunks).decode() == big
    seen = b""
    for _, data, digest in chunks:
        seen += data
        assert digest == hashlib.sha256(seen).hexdigest()


def test_archives_are_standard(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "hello")], "page_id long, url string, html string")
    (path,) = [r["archive"] for r in warc.write_archives(pages, str(tmp_path / "w")).collect()]
    with gzip.open(path) as f:
        raw = f.read()
    head, block = raw.split(b"\r\n\r\n", 1)
    length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and block[length:] == b"\r\n\r\n" and block[:length].endswith(b"\r\n\r\nhello")


def test_broken_archives_are_errors():
    with pytest.raises(ValueError):
        list(warc.read_records(warc._Lines(io.BytesIO(b"nonsense\r\n")), 10))
    head = warc._header("response", 500, {"WARC-Record-ID": "x"}) + warc._HTTP
    with pytest.raises(ValueError):
        list(warc.read_records(warc._Lines(io.BytesIO(head + b"cut off")), 10))


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, str(tmp_path / "none"))
    assert warc.read_archives(spark, manifest).count() == 0
