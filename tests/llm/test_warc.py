import base64
import hashlib

import pytest

from gapline.llm import warc


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    firsts = {}
    for page, _, html in rows:
        if page is not None:
            firsts[html or ""] = min(page, firsts.get(html or "", page))
    copies = [html or "" for _, _, html in rows]
    out = []
    for page, _, html in rows:
        text = html or ""
        first = firsts.get(text)
        again = len(text.encode()) >= least and copies.count(text) > 1 and first is not None and page != first
        out.append((page, len(text.encode()), sha(text), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


MAGIC, CLOSE = warc.MAGIC, warc.CLOSE
HTML = [
    "<p>a</p>", "<p>a</p>", None, "", "né ☃", MAGIC, MAGIC * 3, "x" + MAGIC + "y", CLOSE + MAGIC + "Content-Length: 5" + CLOSE + "12345" + CLOSE,
    MAGIC + "WARC-Type: response\r\nContent-Length: 0" + CLOSE + CLOSE + MAGIC, "WARC/1.1\n", "tail\r\n\r\n", "\r\n" * 5, "z" * 50_000, MAGIC[:-1], MAGIC[:5],
]


@pytest.mark.parametrize("split", ["100", "4096", "10000000"])
def test_round_trip_with_magic_in_payloads(spark, split):
    rows = [(i, f"http://a/{i}\r\nX: y", h) for i, h in enumerate(HTML * 3)] + [(None, None, "<p>a</p>"), (3, "u", ""), (0, "u", "<p>a</p>"), (None, "u", "alone")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for least in (0, 9):
            got = warc.round_trip(pages, least).collect()
            assert sorted(map(str, map(tuple, got))) == brute(rows, least)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_broken_chain_and_empty(spark, tmp_path):
    good = lambda i, text: f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(text)}{CLOSE}{text}{CLOSE}"
    (tmp_path / "a").write_bytes((good(1, "one") + good(2, "two") + f"{MAGIC}Content-Length: 99{CLOSE}short{CLOSE}" + good(3, "three")).encode())
    (tmp_path / "b").write_bytes(b"junk" + good(4, "four").encode())
    (tmp_path / "c").write_bytes(b"")
    found = warc.read_archives(spark, f"file:{tmp_path}").collect()
    assert sorted(r["body"] for r in found) == ["one", "two"]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0


def test_record_ids_of_repeated_pages(spark):
    rows = [(1, "u", "a"), (1, "v", "b"), (2, "u", "a"), (2, "v", "b"), (None, "w", "c"), (3, "x", None)]
    found = warc.records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    heads = [r["value"].split(CLOSE)[0].split("\r\n") for r in found.collect()]
    field = lambda head, name: next((line.split(": ", 1)[1] for line in head if line.startswith(name)), None)
    ids = [field(h, "WARC-Record-ID") for h in heads]
    named = [field(h, "WARC-Refers-To") for h in heads]
    assert len(set(ids)) == len(rows) and sum(n is not None for n in named) == 2 and {n for n in named if n} <= set(ids)
