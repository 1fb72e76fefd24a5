import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer

from pyspark.sql import functions as F

from gapline import __main__ as command
from gapline.functions import text as T
from gapline.operators import gate, lexicon
from gapline.plans import analysis, labellers
from gapline.sources import datagen, http


def test_commands(spark, tmp_path):
    at = lambda name: f"file:{tmp_path}/{name}"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "jd.txt").write_text("We need Python, Docker and 5 years of experience in Kubernetes.")
    (tmp_path / "in" / "cv.txt").write_text("Python and Docker, 6 years.")
    assert command.main(["texts", at("in"), "--out", at("docs")]) == 0
    assert command.main(["extract", at("docs"), "--out", at("spans")]) == 0
    assert {r["span"] for r in spark.read.parquet(at("spans")).collect()} >= {"Python", "Docker", "Kubernetes"}
    docs = spark.read.parquet(at("docs"))
    key = lambda name: docs.filter(F.col("doc_key").endswith(name)).first()["doc_key"]
    schema = "pair_id int, jd_key string, resume_key string"
    spark.createDataFrame([(1, key("jd.txt"), key("cv.txt"))], schema).write.parquet(at("pairs"))
    assert command.main(["analyze", at("docs"), at("pairs"), "--out", at("result")]) == 0
    assert {x["span"] for x in spark.read.parquet(at("result")).first()["missing"]} == {"Kubernetes"}
    spark.createDataFrame([(1, key("jd.txt"), "nobody")], schema).write.parquet(at("none"))
    assert command.main(["analyze", at("docs"), at("none"), "--json", "--out", at("json")]) in (0, 1)
    assert "missing" in json.loads(spark.read.parquet(at("json")).first()["json"])
    assert command.main(["datagen", "--samples", "20", "--out", at("samples")]) == 0


class Service(BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(200 if self.path == "/health" else 404)
        self.end_headers()

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.send_response(500 if asked.get("bad") else 200)
        self.end_headers()
        self.wfile.write(json.dumps({"feedback": f"for {asked.get('n')}"} if not asked.get("none") else {}).encode())

    def log_message(self, *_):
        pass


def test_service(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    rows = spark.createDataFrame([(1, '{"n": 7}'), (2, '{"bad": true}'), (3, '{"none": true}')], "pair_id int, body string")
    got = {r["pair_id"]: r for r in http.request_feedback(rows, url, 10).collect()}
    assert got[1]["feedback"] == "for 7" and got[1]["error"] is None
    assert got[2]["feedback"] is None and "HTTPError" in got[2]["error"] and "KeyError" in got[3]["error"]
    assert http.healthy(url, 10) and not http.healthy(f"{url}nothing", 10)
    server.shutdown()
    server.server_close()
    assert not http.healthy(url, 1)


class Moody(Service):
    """Fails each body's first request and takes a while for every other."""

    seen: dict = {}
    open_now = most_open = 0
    lock = threading.Lock()

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        with Moody.lock:
            Moody.seen[body] = Moody.seen.get(body, 0) + 1
            first = Moody.seen[body] == 1
            Moody.open_now += 1
            Moody.most_open = max(Moody.most_open, Moody.open_now)
        time.sleep(0.2)
        with Moody.lock:
            Moody.open_now -= 1
        asked = json.loads(body)
        self.send_response(400 if asked.get("bad") else 503 if first or asked.get("down") else 200)
        self.end_headers()
        self.wfile.write(json.dumps({"feedback": f"for {asked.get('n')}"}).encode())


def test_failing_and_slow_service(spark):
    """Failures are asked again, refusals are not, requests overlap, and what fails for good gets the template."""
    server = ThreadingHTTPServer(("127.0.0.1", 0), Moody)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    rows = [(k, None, f'{{"n": {k}}}') for k in range(20)] + [(50, None, '{"bad": 1}'), (51, None, '{"down": 1}'), (52, "refused", '{"n": 52}')]
    result = spark.createDataFrame(rows, "pair_id int, problem string, body string").coalesce(1)
    result = result.withColumn("missing", F.lit(None).cast("array<struct<ord:int,category:string,span:string>>"))
    out = {r["pair_id"]: r for r in analysis.served_feedback(result, F.col("body"), url, timeout=10, in_flight=6, attempts=3).collect()}
    server.shutdown()
    server.server_close()
    assert all(out[k]["feedback"] == f"for {k}" and out[k]["service_error"] is None and not out[k]["notices"] for k in range(20))
    assert "400" in out[50]["service_error"] and "503" in out[51]["service_error"]
    assert all(out[k]["feedback"] and out[k]["notices"] for k in (50, 51)) and out[52]["feedback"] is None
    times = {json.dumps(json.loads(b)): n for b, n in Moody.seen.items()}
    assert times['{"bad": 1}'] == 1 and times['{"down": 1}'] == 3 and times['{"n": 3}'] == 2 and '{"n": 52}' not in times
    assert 2 <= Moody.most_open <= 6


def test_windowed_labels_are_those_of_the_whole(spark):
    docs = datagen.generate(spark, 60).select(F.col("id").alias("doc_key"), F.array_join("words", " ").alias("text"))
    docs = docs.groupBy(F.floor(F.col("doc_key") / 6).alias("doc_key")).agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    docs = docs.union(spark.createDataFrame([(100, ""), (101, None), (102, "\u00ad \u00ad")], "doc_key long, text string"))
    rows = lambda df: sorted((r["doc_key"], r["pos"], r["word"], r["label"]) for r in df.collect())
    whole = rows(labellers.lexicon_labeller(docs))
    assert rows(labellers.windowed(labellers.lexicon_labeller, 60)(docs)) == whole and len(whole) > 500


def test_candidate_search_misses_no_term(spark):
    """Every window whose key is a term begins at a word that the alternation finds, and its window is long enough."""
    terms = ("ty", "machine learning", "c++", "c#", "node.js", "data", "amazon web service", "r", "class", "policy", "a b testing", "ci cd", "net core")
    words = ["ties", "Ties", "ML", "mls", "C++", "c#x", "Node.js", "node.js,", "DATA-base", "a.w.s", "A.W.S.", "R", "r.", "(data)", "classes", "policies", "\u212aafka", "…", "d\u200bata",
             "dat", "x", "Machine", "Learnings", "(", "ci", "/", "CD", "ci/cd", "A/B", "a", "b", "testing", "amazon", "web", "services", ".NET", "core", "learning"]
    draw = random.Random(2)
    texts = [[draw.choice(words) for _ in range(draw.randrange(12))] for _ in range(150)] + [["machine", "(", ")", "learning"], []]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, w array<string>")
    hits = lexicon.named_windows(rows, "k", F.col("w"), terms)
    got = {(r["k"], h["i"], h["k"], h["term"]) for r in hits.collect() for h in r["hits"]}
    windows = [(k, i, n, " ".join(t[i : i + n])) for k, t in enumerate(texts) for i in range(len(t)) for n in (1, 2, 3) if i + n <= len(t)]
    keys = spark.createDataFrame(windows, "k int, i int, n int, raw string").withColumn("term", T.canonical(F.col("raw"))).filter(F.col("term").isin(*terms)).collect()
    longest = {}
    for r in keys:
        single = {w.lower() for w in texts[r["k"]] if len(w) == 1}
        if len(r["term"]) > 1 or r["term"] in single:
            longest[r["k"], r["i"]] = max(longest.get((r["k"], r["i"]), (0, "")), (r["n"], r["term"]))
    want, free = set(), {}
    for (k, i), (n, term) in sorted(longest.items()):
        if i >= free.get(k, 0):
            want.add((k, i, n, term))
            free[k] = i + n
    assert got == want and len(want) > 200


def test_word_counts_follow_the_definition(spark):
    texts = ["(Python), node.js CI/CD " + "x" * 21 + " 12 漢字 Zürich a@b --", "", "  ", None, "a" * 20 + ". 'don't' -a- é1b", "x\u00a0y\u2003z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(gate.counts(F.col("t")).alias("c"), F.size(T.words(F.col("t"))).alias("w"), F.size(F.filter(T.chunks(F.col("t")), lambda c: c.rlike(T.ALNUM))).alias("n")).collect()
    assert [(r["c"]["words"], r["c"]["chunks"]) for r in got] == [(r["w"], r["n"]) if t is not None else (None, None) for t, r in zip(texts, got)]


def test_analysis_of_nothing(spark):
    none = spark.createDataFrame([], "doc_key string, text string")
    pairs = spark.createDataFrame([], "pair_id int, jd_key string, resume_key string")
    assert analysis.analyze(pairs, none).count() == 0
