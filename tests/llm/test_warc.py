import base64
import gzip
import hashlib

from docquery.llm import common, warc


def brute(data, least=0):
    best = {}
    for page, _, html in data:
        if page is not None and len((html or "").encode()) >= least:
            best[html or ""] = max(best.get(html or "", page), page)
    out = []
    for page, _, html in data:
        payload = (html or "").encode()
        to = best.get(html or "")
        revisit = to is not None and page != to
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    data = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    data += [(900 + i, "http://hot.example.com/a", "<p>same é</p>") for i in range(30)]
    data += [(1000, None, None), (1001, "http://x.org", ""), (1002, "http://x.org\r\nEvil: 1", "a\r\n\r\nb"), (1003, "not a url [", "x" * 300_000), (None, "http://n.org", "<p>same é</p>"), (None, "http://n.org", "only null"), (929, "http://hot.example.com/a", "<p>same é</p>")]
    df = spark.createDataFrame([(*r, "d", 1) for r in data], "page_id long, url string, html string, digest string, n_bytes int")
    for least in (0, 1, 14):
        directory = warc.archive(df, least)
        got = warc.read_archives(directory).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(data, least)
        got = warc.look_up(directory, df).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(data, least)
    by_id = {p: h for p, _, h in data}
    assert all(bytes(r.payload).decode() == (by_id[r.page_id] or "") for r in got if r.record_type == "response" and r.page_id is not None)
    assert len(warc.find(directory, "http://hot.example.com/a")) == 31 and warc.find(directory, "http://absent.example.com/") == []
    for page, url, _ in data[:20]:
        assert page in [x["page_id"] for x in warc.find(directory, url)]
    empty = warc.archive(df.limit(0))
    assert warc.read_archives(empty).count() == 0 and warc.look_up(empty, df).count() == 0 and warc.find(empty, "http://x.org") == []
    assert warc.look_up(directory, df.limit(0)).count() == 0


def test_binary_search_over_blocks(tmp_path):
    """Keys that fill several blocks, keys that begin inside one, and keys between, before and after all of them."""
    lines = sorted([("b", p) for p in [None, *range(25)]] + [("c", 1), ("e", None), ("e", 7)], key=lambda x: warc._place(*x))
    index = warc.Index([])
    blocks = [lines[i : i + 4] for i in range(0, len(lines), 4)]
    index.entries = [(*b[0], i, 0, 0) for i, b in enumerate(blocks)]
    index.starts = [warc._place(*b[0]) for b in blocks]
    index._lines = lambda at: [[*x, f"{x[0]}{x[1]}", 0, 0] for x in blocks[at]]
    for key in "abcdef":
        pages = [p for k, p in lines if k == key]
        assert [c[0] for c in index.captures(key, every=True)] == [f"{key}{p}" for p in pages]
        for p in [None, *range(-1, 27)]:
            assert [c[0] for c in index.captures(key, p)] == ([f"{key}{p}"] if p in pages else [])


def test_keys_and_members():
    assert warc.url_key("http://www.a.example.com:8080/x?y=1#z") == "com,example,a:8080)/x?y=1"
    assert warc.url_key("https://b.org") == "org,b)/"
    content = warc.record(5, "http://b.org", 3, warc.payload_digest(b"abc"), b"abc", None)
    assert warc.parse(gzip.decompress(gzip.compress(content)))["payload"] == b"abc"
    assert common.file_at("/tmp/x")[1] == "/tmp/x"
