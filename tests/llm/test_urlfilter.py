import re

import numpy as np

from gapline.llm import urlfilter


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h, p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3] + best[4], best[2] if best else "allow"


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    labels, bits = ["a", "b", "com", "B"], ["/", "x", "y", "/x", ""]
    host = lambda: ".".join(rng.choice(labels, rng.integers(1, 5)))
    path = lambda: "".join(rng.choice(bits, rng.integers(0, 5)))
    rules = {(host().lower(), "/" + path() if rng.random() < 0.8 else ""): str(rng.choice(["allow", "block"])) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{host()}/{path()}{rng.choice(['', '?q', '#f', '?a://b'])}" for _ in range(500)]
    urls += [None, "", "nope", "://", "x://", "ftp://a.com", "http://a.com?x/y", "http://com/\n/x", "http://" + "a." * 300 + "com/x"]
    rows = [(i % 400, u, "clash") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    table = spark.createDataFrame(rules + [(None, "/x", "block"), ("com", None, "block")] , "host string, path string, verdict string")
    rules += [("com", "", "block")]
    want = sorted(map(str, ((r[0], *brute(r[1], rules)) for r in rows)))
    got = urlfilter.judge(pages, table).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == want
    assert urlfilter.judge(pages.limit(0), table).count() == 0 and urlfilter.judge(pages, table.limit(0)).filter("rule is null").count() == len(rows)


def test_many_ranges_give_the_same(spark):
    pages = spark.createDataFrame([(i, f"http://a{i % 7}.com/p/{i}") for i in range(300)], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block"), ("a3.com", "/p/1", "allow"), ("a3.com", "/p/15", "block")], "host string, path string, verdict string")
    one, many = (
        sorted(map(tuple, urlfilter.match(urlfilter.url_parts(pages), rules, n).collect())) for n in (10**6, 20)
    )
    assert one == many and len(one) == 300
