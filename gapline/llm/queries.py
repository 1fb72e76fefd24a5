"""The queries of the training-data operators; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import decontaminate, exactdedup, fim, gif, linededup, lm, packing, pii, simhash, toxicity, turnrepair, urlfilter, warc
from gapline.llm.common import crc_bucket, materialize, table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                               ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT row_number() OVER () AS n, page_id,
                 translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC) AS k
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP4_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, b, min(page_id) AS first FROM d WHERE page_id IS NOT NULL GROUP BY x, b),
t AS (SELECT page_id, b, first, list_transform([1, 6, 11, 16, 21, 26, 31, 36], lambda i: ('0x' || substr(x, i, 5))::BIGINT) AS g FROM d LEFT JOIN f USING (x, b))
SELECT page_id, b::BIGINT AS payload_bytes,
  array_to_string(list_transform(g, lambda n: array_to_string(list_transform([32768, 1024, 32, 1], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n // k % 32 + 1)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM t
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return kept.select(
        "doc_id", "n_lines", "n_removed", F.char_length("text").alias("n_chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (
  SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
found AS (SELECT r, i, n, item FROM (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM places, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)) JOIN win USING (n, k)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


#: For these synthetic tables only: who reads this can undo the pseudonyms. Real texts need a key that is kept secret.
OPEN_KEY = "key of the registered query"


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), OPEN_KEY)


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = gif.store(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return gif.read_back(materialize(stored, "gif"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "rejected")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT doc_id, t, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS k FROM d),
f AS (SELECT doc_id, t, u, n, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 50 THEN 'plain' WHEN k[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM p
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turnrepair.with_all(turnrepair.repair(turnrepair.damage(turns)), turns)


def _add(x: str, cost: str, edit: str) -> str:
    """SQL of an element of ten digits and an audit, ~ if there is none."""
    return f"CASE WHEN {x} = '~' THEN '~' ELSE lpad((left({x}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({x}, 11) || '{edit}' END"


_CLOSED = f"""SELECT cid, i, s0, s1, c2, least(s3, {_add('c2', '2', 'I')}) AS c3 FROM (SELECT cid, i, s0, s1, s3, least(s2, {_add('least(s0, s1, s3)', '2', 'I')}) AS c2 FROM {{source}})"""
OP13_SQL = rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS codes FROM conversations),
coded AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295::BIGINT, codes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM raw, tab),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(2) AS r(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
ids AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
ranked AS (SELECT cid, turn, role, text, left(role, 1) AS r, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged JOIN ids ON damaged.conv_id IS NOT DISTINCT FROM ids.conv_id),
judged AS (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS seen, regexp_matches(text, '[.!?][ 	-
]*$') AS ended, lag(r) OVER (PARTITION BY cid ORDER BY i) || r AS two FROM ranked),
turns AS (SELECT *, blank OR seen AS bad, CASE WHEN NOT blank AND NOT seen AND NOT ended THEN 1 ELSE 0 END AS cutoff FROM judged),
counts AS (SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank)::BIGINT AS blank, count_if(seen AND NOT blank)::BIGINT AS duplicate, sum(cutoff)::BIGINT AS truncated,
  count_if(two NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM turns GROUP BY cid),
steps AS (
  SELECT cid, 0::BIGINT AS i, '0000000000' AS s0, '~' AS s1, '~' AS s2, '~' AS s3 FROM counts
  UNION ALL
  SELECT c.cid, t.i, {_add('s0', '3', 'D')},
    least({_add('s1', '3', 'D')}, CASE WHEN NOT bad AND r = 's' THEN {_add('s0', 'cutoff', 'K')} ELSE '~' END),
    least({_add('c2', '3', 'D')}, CASE WHEN bad THEN '~' WHEN r = 'u' THEN {_add('least(s0, s1, c3)', 'cutoff', 'K')} ELSE {_add('least(s0, s1, c3)', '2 + cutoff', 'R')} END),
    least({_add('c3', '3', 'D')}, CASE WHEN bad THEN '~' WHEN r = 'a' THEN {_add('c2', 'cutoff', 'K')} ELSE {_add('c2', '2 + cutoff', 'R')} END)
  FROM ({_CLOSED.format(source='steps')}) c JOIN turns t ON t.cid = c.cid AND t.i = c.i + 1),
ends AS (SELECT cid, least(s0, c3) AS e FROM ({_CLOSED.format(source='(SELECT steps.* FROM steps JOIN counts ON steps.cid = counts.cid AND i = n)')})),
edits AS (SELECT cid, unnest(range(1, length(e) - 9)) AS p, unnest(string_split(substr(e, 11), '')) AS edit, e FROM ends WHERE length(e) > 10),
placed AS (SELECT cid, p, edit, count_if(edit <> 'I') OVER w AS i, count_if(edit <> 'D') OVER w AS o, count_if(edit <> 'D') OVER (PARTITION BY cid) % 2 AS system FROM edits WINDOW w AS (PARTITION BY cid ORDER BY p)),
lines AS (SELECT placed.cid, string_agg(CASE edit WHEN 'K' THEN role || ':' || text ELSE CASE WHEN (o - 1 - system) % 2 = 0 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN text ELSE '' END END, chr(10) ORDER BY p) AS body
  FROM placed LEFT JOIN turns ON turns.cid = placed.cid AND turns.i = placed.i AND edit <> 'I' WHERE edit <> 'D' GROUP BY placed.cid)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(e, 10)::BIGINT, 0) AS cost, coalesce(substr(e, 11), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (cid) LEFT JOIN ends USING (cid) LEFT JOIN lines USING (cid)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_pii_pseudonyms": op8_pii_pseudonyms,
    "op9_gif_media": op9_gif_media,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": OP1_SQL,
    "op4_warc": OP4_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
