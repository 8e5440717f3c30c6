import base64
import gzip
import hashlib

import pytest
from conftest_llm import SF, needs_tables

from hazeflow.llm import queries, warc

ODD = [
    (1, "http://a/b c\r\nX: y", "x"), (2, None, "x"), (3, "q", "x"), (None, "q", "x"), (None, "r", "only null"), (4, "http://é/ü?x", None),
    (5, "u", ""), (5, "u", ""), (6, "a", "WARC/1.1\r\n\r\nfoo\r\n\r\n"), (7, "a", "é🙂\r\n\r\n\x00"), (8, "a", "z" * 300_000), (8, "b", "z" * 300_000),
]


def plain(rows):
    groups = {}
    for i, url, html in rows:
        groups.setdefault(html or "", []).append((i, url))
    out, seen = [], set()
    for i, url, html in rows:
        data = (html or "").encode()
        keeper = max(groups[html or ""], key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
        again = (i, url) != keeper or (i, url, html or "") in seen  # one of equal pages is the response
        seen.add((i, url, html or ""))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if again else "response", keeper[0] if again else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, keeper int").repartition(3)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@needs_tables
def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "pages").select("page_id", "url", "html").collect()]
    assert told(queries.all_queries()["op3_warc_transactions"](spark, SF)) == plain(rows)


@pytest.mark.parametrize("bound", [warc.BROADCAST_DIGESTS, 0])
def test_odd_pages(spark, folder, monkeypatch, bound):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", bound)
    assert told(warc.archived(frame(spark, ODD), folder("w"))) == plain(ODD)


def test_every_page_has_its_own_capture(spark, folder):
    rows = [(1, "a", "x")] * 5 + [(2, "a", "y"), (None, "u", None), (None, "u", None), (None, "u", ""), (3, None, "x"), (3, None, "x")]
    warc.write_archives(frame(spark, rows), folder("w"))
    found = warc.captures(warc.read_records(spark, folder("w")))
    assert found.count() == found.select("capture").distinct().count() == len(rows)
    assert told(warc.archived(frame(spark, rows), folder("v"))) == plain(rows)


def test_empty_table(spark, folder):
    assert warc.archived(frame(spark, ODD).limit(0), folder("w")).count() == 0


def test_nested_captures(spark, folder):
    warc.write_archives(frame(spark, ODD), folder("w"), pages_per_file=2)
    found = warc.captures(warc.read_records(spark, folder("w"))).collect()
    payloads = {r.metadata.page_id: r.response.payload for r in found if r.response.type == "response"}
    assert payloads["7"] == "é🙂\r\n\r\n\x00".encode() and payloads["6"] == b"WARC/1.1\r\n\r\nfoo\r\n\r\n" and payloads["5"] == b""
    for r in found:
        assert r.capture == r.response.record_id and r.request.target_uri == r.response.target_uri
        assert (r.response.payload is None) == (r.response.type == "revisit")
        assert r.request.block.startswith("GET /") and "200 OK" in r.response.block
    by_id = {r.capture: r for r in found}
    for r in found:
        if r.response.refers_to:
            assert by_id[r.response.refers_to].response.payload_digest == r.response.payload_digest


def test_files_are_plain_warc(spark, folder, tmp_path):
    warc.write_archives(frame(spark, ODD[:3]), folder("w"))
    files = [p for p in (tmp_path / "w").iterdir() if p.suffix == ".gz"]
    records = [kind for p in files for kind in warc._records(gzip.decompress(p.read_bytes()))]
    assert sorted(f["WARC-Type"] for f, _ in records) == ["metadata"] * 3 + ["request"] * 3 + ["response"] + ["revisit"] * 2
    assert all(len(block) == int(f["Content-Length"]) for f, block in records)


def test_damage_is_noticed():
    digest = base64.b32encode(hashlib.sha1(b"whole").digest()).decode()
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<x>", "WARC-Payload-Digest": f"sha1:{digest}"}
    assert warc._parsed(fields, b"HTTP/1.1 200 OK\r\n\r\nwhole")["payload"] == b"whole"
    with pytest.raises(ValueError):
        warc._parsed(fields, b"HTTP/1.1 200 OK\r\n\r\ncut")
