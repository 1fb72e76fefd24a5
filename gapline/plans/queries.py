"""The registered queries of the engine, each with its DuckDB SQL where SQL can say it. All read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapline import constants as C
from gapline.functions import sql
from gapline.functions import text as T
from gapline.functions import years as Y
from gapline.operators import compose, gate, lexicon, matching, metrics, sequence
from gapline.plans import analysis
from gapline.plans import oracle as O
from gapline.plans.inputs import Inputs, quoted, values
from gapline.plans.labellers import classifier_labeller, labelled_samples, lexicon_labeller, raw_vocabulary, train_token_classifier, windowed
from gapline.session import fresh_path, materialize, ship_package
from gapline.sources import conll, datagen

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STOPWORDS = [w for w in C.GENERIC_TERMS if " " not in w]

# --- texts ----------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS tokens_md5 FROM (SELECT doc_id, {O.tokens('text')} AS t FROM documents)")
def tokenize_stats(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "|").cast("binary")).alias("tokens_md5"))


@query(f"SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, trim(regexp_replace(text, '[{O.SPACES}]+', ' ', 'g'), ' ') AS t FROM documents)")
def whitespace_collapse(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", T.collapse_whitespace(F.col("text")).alias("t"))
    return rows.select("doc_id", F.char_length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query(f"""SELECT conv_id, turn, v <> '' AS has_text, md5(v) AS visible_md5 FROM (SELECT conv_id, turn,
  {O.strip("translate('​' || text || '­' || chr(65279), chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || chr(173) || chr(6158), '')")} AS v FROM conversations)""")
def visible_text(spark, sf_dir):
    hidden = F.concat(F.lit("​"), "text", F.lit("­﻿"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.visible_text(hidden).alias("v"))
    return rows.select("conv_id", "turn", (F.col("v") != "").alias("has_text"), F.md5(F.col("v").cast("binary")).alias("visible_md5"))


@query("""SELECT page_id, md5(t) AS trimmed_md5, CASE WHEN i <> '' THEN ord(i) END AS interior FROM (SELECT page_id, t, regexp_extract(t, '([\\p{Cf}\\p{Cc}])', 1) AS i
  FROM (SELECT page_id, regexp_replace(chr(65279) || html, '^[\\p{Cf}\\p{Cc}]+|[\\p{Cf}\\p{Cc}]+$', '', 'g') AS t FROM pages))""")
def invisible_scan(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", T.scan_invisible(F.concat(F.lit("﻿"), "html")).alias("s"))
    return rows.select("page_id", F.md5(F.col("s.trimmed").cast("binary")).alias("trimmed_md5"), F.ascii("s.interior").alias("interior"))


@query(f"""SELECT doc_id, md5(array_to_string(list_filter({O.chunks(f"regexp_replace(text, '[^{O.SPACES}" + chr(92) + "p{L}" + chr(92) + "p{N}_.]', '', 'g')")}, lambda w: lower(w) NOT IN ({O.listed(STOPWORDS)})), ' ')) AS kept_md5 FROM documents""")
def stopword_removal(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(T.remove_stopwords(F.col("text"), STOPWORDS).cast("binary")).alias("kept_md5"))


@query(f"""SELECT conv_id, n AS turn_pairs, sha256(length(a)::VARCHAR || chr(0) || a || length(b)::VARCHAR || chr(0) || b) AS fingerprint,
  'feedback_' || coalesce(nullif(trim(regexp_replace(lower(role), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), ''), 'role') || '_' || left(sha256(length(a)::VARCHAR || chr(0) || a || length(b)::VARCHAR || chr(0) || b), 8) || '.txt' AS file_name
  FROM (SELECT conv_id, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn % 2 = 0) AS a, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn % 2 = 1), '') AS b,
    CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'Senior  Dev/Ops #' || conv_id END AS role FROM conversations GROUP BY conv_id) WHERE a IS NOT NULL""")
def fingerprint(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    texts = lambda odd: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") % 2 == odd, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    role = F.when(F.col("conv_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Senior  Dev/Ops #"), F.col("conv_id").cast("string")))
    pairs = rows.groupBy("conv_id").agg(F.count("*").alias("turn_pairs"), texts(0).alias("a"), texts(1).alias("b"), F.count(F.when(F.col("turn") % 2 == 0, 1)).alias("k")).filter("k > 0")
    marked = pairs.withColumn("fingerprint", T.fingerprint(F.col("a"), F.col("b")))
    return marked.select("conv_id", "turn_pairs", "fingerprint", T.draft_filename(role, F.col("fingerprint")).alias("file_name"))


@query("""SELECT conv_id AS pair_id, conv_id % 3 = 0 OR n % 5 = 0 AS is_stale FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)""")
def stale_results(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("pair_id")).agg(F.count("*").alias("n"), F.coalesce(F.min("text"), F.lit("")).alias("jd_text"))
    old = rows.withColumn("resume_text", F.lit("x"))
    results = old.select("pair_id", T.fingerprint(F.col("jd_text"), F.col("resume_text")).alias("fingerprint"))
    now = old.withColumn("resume_text", F.when(F.col("pair_id") % 3 == 0, F.lit("y")).otherwise(F.lit("x"))).filter("n % 5 <> 0")
    return matching.stale_results(results, now).select("pair_id", "is_stale")


# --- spans ----------------------------------------------------------------------------------------------------


def all_spans(made: Inputs) -> DataFrame:
    return made.jd_spans.select("span").union(made.resume_spans.select("span")).distinct()


PLURALS = "SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)"


@query(f"{O.FACTS} SELECT raw AS span, canon, {O.generic('canon')} AS is_generic FROM canon")
def canonical_keys(spark, sf_dir):
    rows = all_spans(Inputs(spark, sf_dir)).select("span", T.canonical(F.col("span")).alias("canon"))
    return rows.withColumn("is_generic", T.is_generic(F.col("canon")))


@query(f"SELECT w AS word, {O.fold('w')} AS folded FROM ({PLURALS})")
def plural_fold(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1), F.lower))).alias("word")).distinct()
    return found.select("word", T.fold_plural(F.col("word")).alias("folded"))


@query(f"SELECT p_partkey, {O.acronym('w')} AS collapsed, {O.normalize('p_brand || w')} AS normalized FROM (SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN 'a.w.s' WHEN 1 THEN 'b.sc' WHEN 2 THEN 'node.js' ELSE 'x.' || p_size || '.y.z.' END AS w FROM part)")
def dotted_acronym(spark, sf_dir):
    k = F.col("p_partkey") % 4
    w = F.when(k == 0, "a.w.s").when(k == 1, "b.sc").when(k == 2, "node.js").otherwise(F.concat(F.lit("x."), F.col("p_size").cast("string"), F.lit(".y.z.")))
    rows = read(spark, sf_dir, "part").withColumn("w", w)
    return rows.select("p_partkey", T.collapse_acronym(F.col("w")).alias("collapsed"), T.normalize(F.concat("p_brand", "w")).alias("normalized"))


@query(f"{O.FACTS} SELECT span, string_agg(DISTINCT term, '|' ORDER BY term) AS terms, any_value(b.best) AS best FROM rec JOIN best b USING (span) GROUP BY span")
def recognise_terms(spark, sf_dir):
    found = lexicon.recognised(all_spans(Inputs(spark, sf_dir)))
    return found.select("span", F.array_join("terms", "|").alias("terms"), "best")


DOCUMENT_WORDS = f"list_filter({O.tokens('text')}, lambda w: regexp_matches(w, '[a-zA-Z0-9]'))"


@query(f"WITH {O.LEXICON}, {O.recognised('rec', 'documents', 'doc_id', DOCUMENT_WORDS)} SELECT doc_id, count(*) AS n_hits, count(DISTINCT term) AS n_terms, string_agg(DISTINCT term, '|' ORDER BY term) AS terms FROM rec GROUP BY doc_id")
def lexicon_hits_documents(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    words = T.word_tokens(F.col("text"))
    hits = lexicon.named_windows(rows, "doc_id", words)
    terms = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["term"])))
    return hits.select("doc_id", F.size("hits").cast("long").alias("n_hits"), F.size(terms).cast("long").alias("n_terms"), F.array_join(terms, "|").alias("terms"))


@query(f"{O.FACTS} SELECT raw AS span, years FROM years")
def parse_years(spark, sf_dir):
    return all_spans(Inputs(spark, sf_dir)).select("span", Y.parse_years(F.col("span")).alias("years"))


# --- SQL only: the functions as a SQL user calls them -----------------------------------------------------------


@query(f"""{O.FACTS} SELECT canon.raw AS span, canon.canon AS canon, {O.generic('canon.canon')} AS is_generic, years, level,
  coalesce((SELECT string_agg(DISTINCT term, '|' ORDER BY term) FROM rec WHERE rec.span = canon.raw), '') AS terms
  FROM canon JOIN years ON years.raw = canon.raw JOIN level ON level.raw = canon.raw""")
def sql_span_facts(spark, sf_dir):
    sql.register(spark)
    return spark.sql(
        """SELECT span, gapline_canonical(span) AS canon, gapline_is_generic(gapline_canonical(span)) AS is_generic, gapline_years(span) AS years,
          gapline_degree(span) AS level, array_join(gapline_terms(span), '|') AS terms FROM {spans}""",
        spans=all_spans(Inputs(spark, sf_dir)),
    )


@query(f"{O.FACTS} SELECT term, count(*) AS n_spans, sum(k) AS n_words, count(*) FILTER (WHERE i = 0) AS n_first FROM rec GROUP BY term")
def sql_term_counts(spark, sf_dir):
    sql.register(spark)
    return spark.sql(
        """SELECT term, count(*) AS n_spans, sum(k) AS n_words, count_if(i = 0) AS n_first FROM {spans}, LATERAL gapline_recognise(span) GROUP BY term""",
        spans=all_spans(Inputs(spark, sf_dir)),
    )


@query(f"""SELECT lang, count(*) AS n_docs, sum(len({O.tokens('text')})) AS n_tokens,
  sum(length(trim(regexp_replace(text, '[{O.SPACES}]+', ' ', 'g'), ' '))) AS n_chars FROM documents GROUP BY lang""")
def sql_token_totals(spark, sf_dir):
    sql.register(spark)
    return spark.sql(
        """SELECT lang, count(*) AS n_docs, sum(size(gapline_tokens(text))) AS n_tokens, sum(char_length(gapline_collapse(text))) AS n_chars
        FROM {documents} GROUP BY lang""",
        documents=read(spark, sf_dir, "documents"),
    )


PERIODS = "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%B %Y to Present') WHEN 1 THEN strftime(o_orderdate, '%d days') ELSE strftime(o_orderdate, '%m to %d years') END AS span FROM orders"


@query(f"WITH made AS ({PERIODS}), {O.years('y', 'made')} SELECT o_orderkey, years, regexp_matches(lower(span), '\\b(19|20)[0-9]{{2}}\\b|present') AS is_period FROM made JOIN y ON raw = span")
def date_range_abstain(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    span = F.when(k == 0, F.concat(F.date_format(d, "MMMM yyyy"), F.lit(" to Present"))).when(k == 1, F.concat(F.date_format(d, "dd"), F.lit(" days"))).otherwise(F.concat(F.date_format(d, "MM"), F.lit(" to "), F.date_format(d, "dd"), F.lit(" years")))
    rows = rows.select("o_orderkey", span.alias("span"))
    return rows.select("o_orderkey", Y.parse_years(F.col("span")).alias("years"), Y.is_period(F.lower("span")).alias("is_period"))


@query(f"{O.FACTS} SELECT raw AS span, level FROM level")
def degree_level(spark, sf_dir):
    return all_spans(Inputs(spark, sf_dir)).select("span", Y.degree_level(F.col("span")).alias("level"))


@query(f"{O.FACTS} SELECT resume_key AS doc_key, held FROM held_level")
def highest_degree(spark, sf_dir):
    return matching.highest_degree(Inputs(spark, sf_dir).resume_spans)


def gaps_query(operator: str, table: str):
    def run(spark, sf_dir):
        made = Inputs(spark, sf_dir)
        return getattr(matching, operator)(made.pairs, made.jd_spans, made.resume_spans)

    run.__name__ = operator
    query(f"{O.FACTS} SELECT pair_id, category, ord, span FROM {table}")(run)


for _operator, _table in (("skill_gaps", "skill_gaps"), ("degree_gaps", "degree_gaps"), ("experience_gaps", "experience_gaps"), ("find_missing", "gaps")):
    gaps_query(_operator, _table)


@query(f"{O.FACTS}, {O.NOTES} SELECT pair_id, array_to_string(notes, ' / ') AS notes FROM notes")
def operator_notes(spark, sf_dir):
    made = Inputs(spark, sf_dir)
    return matching.find_notes(made.pairs, made.jd_spans, made.resume_spans).select("pair_id", F.array_join("notes", " / ").alias("notes"))


@query(f"""{O.FACTS}, n AS (SELECT pair_id, count(*) AS g FROM gaps GROUP BY 1) SELECT n_name, count(*) AS applications, count(g) AS with_gaps, sum(coalesce(g, 0)) AS n_gaps
  FROM pairs JOIN customer ON c_custkey = resume_key JOIN nation ON n_nationkey = c_nationkey LEFT JOIN n USING (pair_id) GROUP BY n_name""")
def match_rate_by_nation(spark, sf_dir):
    made = Inputs(spark, sf_dir)
    gaps = matching.find_missing(made.pairs, made.jd_spans, made.resume_spans).groupBy("pair_id").agg(F.count("*").alias("g"))
    people = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 rows
    joined = made.pairs.join(people.select("c_custkey", "n_name"), F.col("c_custkey") == F.col("resume_key")).join(gaps, "pair_id", "left")
    return joined.groupBy("n_name").agg(F.count("*").alias("applications"), F.count("g").alias("with_gaps"), F.sum(F.coalesce("g", F.lit(0))).alias("n_gaps"))


# --- gate -----------------------------------------------------------------------------------------------------


@query(f"""SELECT kind, key, words, chunks, r.reason AS reason FROM (SELECT *, {O.unreadable('resume')} AS r FROM (SELECT kind, key, text, {O.n_words('text')} AS words, {O.n_chunks('text')} AS chunks FROM (
  SELECT 'doc' AS kind, doc_id AS key, CASE doc_id % 6 WHEN 0 THEN md5(text) || ' ' || md5(lang) || ' x' WHEN 1 THEN '' ELSE text END AS text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages)))""")
def readability(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 6 == 0, F.concat(F.md5(F.col("text").cast("binary")), F.lit(" "), F.md5(F.col("lang").cast("binary")), F.lit(" x"))).when(F.col("doc_id") % 6 == 1, F.lit("")).otherwise(F.col("text"))
    rows = docs.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("key"), text.alias("text"))
    rows = rows.unionByName(read(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("key"), F.col("html").alias("text")))
    rows = rows.withColumn("counted", gate.counts(F.col("text")))
    return rows.select("kind", "key", "counted.words", "counted.chunks", gate.unreadable(F.col("text"), "resume", F.col("counted"))["reason"].alias("reason"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Inputs(spark, sf_dir)
    return gate.gate(made.pairs, made.jd_docs, made.jd_spans, made.resume_docs, made.resume_spans)


@query(f"{O.FACTS}, {O.GATE} SELECT pair_id, problem FROM gate")
def gate_verdict(spark, sf_dir):
    return judged(spark, sf_dir).select("pair_id", "problem")


def analysis_sql(facts: str) -> str:
    return f"""{facts}, {O.NOTES}, {O.GATE}, found AS (SELECT pair_id, string_agg(category || ':' || span, '|' ORDER BY ord, category, span) AS missing, count(*) AS n FROM gaps GROUP BY 1),
analysis AS (SELECT pair_id, problem, CASE WHEN problem IS NULL THEN coalesce(missing, '') END AS missing, CASE WHEN problem IS NULL THEN notes END AS notes, jd_key, resume_key FROM gate JOIN notes USING (pair_id) LEFT JOIN found USING (pair_id))"""


ANALYSIS = analysis_sql(O.FACTS)


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Inputs(spark, sf_dir)
    return analysis.analyze_spans(made.pairs, made.jd_docs, made.jd_spans, made.resume_docs, made.resume_spans)


@query(f"{ANALYSIS} SELECT pair_id, problem, missing, array_to_string(notes, ' / ') AS notes FROM analysis")
def analyze(spark, sf_dir):
    items = F.array_join(F.transform("missing", lambda x: F.concat(x["category"], F.lit(":"), x["span"])), "|")
    return analysed(spark, sf_dir).select("pair_id", "problem", items.alias("missing"), F.array_join("notes", " / ").alias("notes"))


@query(f"""{O.FACTS}, asked AS (SELECT pair_id, jd_key, resume_key FROM pairs), jn AS (SELECT doc_key, count(DISTINCT best) AS n FROM jd_spans JOIN best USING (span) WHERE category IN ({O.listed(C.COMPARABLE)}) GROUP BY 1),
  rn AS (SELECT doc_key, count(DISTINCT best) AS n FROM resume_spans JOIN best USING (span) WHERE category IN ({O.listed(C.COMPARABLE)}) GROUP BY 1)
  SELECT pair_id, CASE WHEN j.n IS NULL OR r.n IS NULL THEN 422 ELSE 200 END AS status FROM asked LEFT JOIN jn j ON j.doc_key = jd_key LEFT JOIN rn r ON r.doc_key = resume_key""")
def service_status(spark, sf_dir):
    made = Inputs(spark, sf_dir)
    return analysis.respond(made.pairs, made.jd_spans, made.resume_spans).select("pair_id", "status")


# --- composed texts -------------------------------------------------------------------------------------------


def label_lines(labels: dict[str, str], table: str, key: str, mark: str) -> str:
    """SQL: a row (key, lines) of labelled lists in the labels' order."""
    order = values([(c, i, label) for i, (c, label) in enumerate(labels.items())], "o(category, n, label)")
    return f"""SELECT {key}, string_agg({O.quoted(mark)} || label || ': ' || items, chr(10) ORDER BY n) AS lines FROM (SELECT {key}, category, string_agg(span, ', ' ORDER BY ord, span) AS items FROM {table} GROUP BY {key}, category) JOIN {order} USING (category) GROUP BY {key}"""


def said(text: str) -> str:
    return O.quoted(text.format(company=compose.COMPANY, recruiter=compose.RECRUITER, role=compose.ROLE))


MAIL_HEAD = f"'Dear Applicant,' || chr(10) || chr(10) || {said(C.MAIL['thanks'])} || chr(10) || chr(10)"
MAIL_TAIL = f"chr(10) || chr(10) || {said(C.MAIL['again'])} || chr(10) || chr(10) || 'Warm regards,' || chr(10) || {said('{recruiter}')} || chr(10) || {said('{company} Recruiting Team')}"


@query(f"""{O.FACTS}, l AS ({label_lines(C.MAIL_LABELS, 'gaps', 'pair_id', '  • ')}) SELECT pair_id, md5({MAIL_HEAD} || coalesce({said(C.MAIL['gaps'])} || chr(10) || chr(10) || lines || chr(10) || chr(10) || {said(C.MAIL['advice'])}, {said(C.MAIL['none'])}) || {MAIL_TAIL}) AS mail_md5
  FROM pairs LEFT JOIN l USING (pair_id)""")
def feedback_email(spark, sf_dir):
    made = Inputs(spark, sf_dir)
    gaps = compose.grouped(matching.find_missing(made.pairs, made.jd_spans, made.resume_spans), "pair_id")
    mails = made.pairs.join(gaps, "pair_id", "left")
    return mails.select("pair_id", F.md5(compose.feedback_mail(F.col("items")).cast("binary")).alias("mail_md5"))


@query(f"""{O.FACTS}, b AS (SELECT pair_id, category, min((ord, category, span)) AS first, upper(left(category, 1)) || substr(category, 2) || ':' || chr(10) || string_agg('- ' || span, chr(10) ORDER BY ord, span) AS block FROM gaps GROUP BY 1, 2)
  SELECT pair_id, md5('Missing skills / qualifications:' || chr(10) || string_agg(block, chr(10) ORDER BY first) || chr(10) || chr(10) || {said(C.GAP_PROMPT)}) AS prompt_md5 FROM b GROUP BY pair_id""")
def gap_prompt(spark, sf_dir):
    made = Inputs(spark, sf_dir)
    gaps = compose.grouped(matching.find_missing(made.pairs, made.jd_spans, made.resume_spans), "pair_id")
    return gaps.select("pair_id", F.md5(compose.gap_prompt(F.col("items")).cast("binary")).alias("prompt_md5"))


@query(f"""WITH {O.SPANS_SQL}, jl AS ({label_lines(C.MAIL_LABELS, 'jd_spans', 'doc_key', '- ')}), rl AS ({label_lines(C.MAIL_LABELS, 'resume_spans', 'doc_key', '- ')})
  SELECT pair_id, md5({said(C.COMPARISON_PROMPT[0])} || coalesce(j.lines, '- (none extracted)') || {said(C.COMPARISON_PROMPT[1])} || coalesce(r.lines, '- (none extracted)') || {said(C.COMPARISON_PROMPT[2])}) AS prompt_md5
  FROM pairs LEFT JOIN jl j ON j.doc_key = jd_key LEFT JOIN rl r ON r.doc_key = resume_key""")
def comparison_prompt(spark, sf_dir):
    made = Inputs(spark, sf_dir)
    left = compose.grouped(made.jd_spans, "doc_key").select(F.col("doc_key").alias("jd_key"), compose.entity_lines(F.col("items")).alias("j"))
    right = compose.grouped(made.resume_spans, "doc_key").select(F.col("doc_key").alias("resume_key"), compose.entity_lines(F.col("items")).alias("r"))
    both = made.pairs.join(left, "jd_key", "left").join(right, "resume_key", "left")
    a, b, c = C.COMPARISON_PROMPT
    names = compose._names(None, None, None)
    none = F.lit("- (none extracted)")
    whole = F.concat(compose.filled(a, **names), F.coalesce("j", none), F.lit(b), F.coalesce("r", none), compose.filled(c, **names))
    return both.select("pair_id", F.md5(whole.cast("binary")).alias("prompt_md5"))


REPORT_ORDER = values([(c, i, label) for i, (c, label) in enumerate(C.REPORT_LABELS.items())], "o(category, n, label)")


@query(f"""{ANALYSIS}, blocks AS (SELECT pair_id, string_agg('  ' || label || ':' || chr(10) || items, chr(10) ORDER BY n) AS body FROM (SELECT pair_id, category, string_agg('    - ' || span, chr(10) ORDER BY ord, span) AS items FROM gaps GROUP BY 1, 2) JOIN {REPORT_ORDER} USING (category) GROUP BY 1)
  SELECT pair_id, md5({O.quoted(C.REPORT['gaps'])} || chr(10) || coalesce(body, CASE WHEN len(notes) > 0 THEN {O.quoted(C.REPORT['none_unchecked'])} ELSE {O.quoted(C.REPORT['none'])} END)) AS gaps_md5,
  CASE WHEN len(notes) > 0 THEN md5({O.quoted(C.REPORT['notes'])} || chr(10) || array_to_string(list_transform(notes, lambda x: '  - ' || x), chr(10)) || chr(10) || {O.quoted(C.REPORT['notes_end'])}) END AS notes_md5
  FROM analysis LEFT JOIN blocks USING (pair_id) WHERE problem IS NULL""")
def report_blocks(spark, sf_dir):
    rows = analysed(spark, sf_dir).filter("problem is null")
    text = lambda c: F.md5(c.cast("binary"))
    return rows.select("pair_id", text(compose.gaps_block(F.col("missing"), F.col("notes"))).alias("gaps_md5"), text(compose.notes_block(F.col("notes"))).alias("notes_md5"))


# --- sequences ------------------------------------------------------------------------------------------------

BUDGET = 60
LENGTHS = f"len_w AS (SELECT doc_id, {O.tokens('text')} AS w FROM documents), len_n AS (SELECT doc_id, len(w) AS n, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[\\p{{Cf}}\\p{{Cc}}]+$') THEN 0 ELSE (length(x) + 3) // 4 END::BIGINT) AS l FROM len_w)"
#: From window to window by doubling: j<k> leads 2 ** k windows on, r<k> are the first 2 ** k windows.
LEVELS = 16
JUMPS = "j0 AS MATERIALIZED (SELECT doc_id, a, nxt FROM step), r0 AS MATERIALIZED (SELECT doc_id, 0 AS win, 0::BIGINT AS a FROM size WHERE n > 0), " + ", ".join(
    f"r{k + 1} AS MATERIALIZED (SELECT * FROM r{k} UNION ALL SELECT r.doc_id, win + {1 << k}, nxt FROM r{k} r JOIN j{k} j USING (doc_id, a)), "
    f"j{k + 1} AS MATERIALIZED (SELECT x.doc_id, x.a, y.nxt FROM j{k} x JOIN j{k} y ON x.doc_id = y.doc_id AND x.nxt = y.a)"
    for k in range(LEVELS)
)
#: win(doc_id, a, e): the window that begins at word a ends before e; step: where the next one begins. A window's end is the last
#: word whose prefix sum is within the budget, one word at least; the overlap is halved while its window would end no later.
PLAN = f"""{LENGTHS}, words AS (SELECT doc_id, unnest(range(n + 1)) AS i, unnest(list_prepend(0::BIGINT, l)) AS l FROM len_n WHERE n > 0),
prefix AS (SELECT doc_id, i, sum(l) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS p FROM words),
last AS (SELECT doc_id, p, max(i) AS i FROM prefix GROUP BY doc_id, p),
fill AS MATERIALIZED (SELECT s.doc_id, s.i AS a, greatest(s.i + 1, l.i) AS e FROM (SELECT doc_id, i, p + {BUDGET} AS p FROM prefix) s ASOF JOIN last l ON s.doc_id = l.doc_id AND s.p >= l.p),
size AS (SELECT doc_id, n FROM len_n), win AS MATERIALIZED (SELECT doc_id, a, least(e, n) AS e, n FROM fill JOIN size USING (doc_id) WHERE a < n),
tried AS (SELECT doc_id, a, e, h, least({C.OVERLAP_WORDS}, (e - a) // 2) // (1 << h)::BIGINT AS o FROM win, range(7) AS r(h) WHERE e < n),
step AS MATERIALIZED (SELECT t.doc_id, t.a, t.e - max(t.o) AS nxt FROM tried t JOIN fill f ON f.doc_id = t.doc_id AND f.a = t.e - t.o WHERE t.o = 0 OR f.e > t.e GROUP BY t.doc_id, t.a, t.e),
{JUMPS}, plan AS (SELECT doc_id, r.win, a, e FROM r{LEVELS} r JOIN win USING (doc_id, a))"""


def token_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), T.tokenize(F.col("text")).alias("w"))
    return rows.select("doc_key", sequence.subword_lengths(F.col("w")).alias("lengths"))


@query(f"WITH {PLAN} SELECT doc_id AS doc_key, win::INT AS win, a::INT AS start, e::INT AS \"end\" FROM plan")
def window_plan(spark, sf_dir):
    plans = token_docs(spark, sf_dir).withColumn("windows", sequence.plan_windows(F.col("lengths"), BUDGET))
    return sequence.window_rows(plans)


WINDOWS = "w AS (SELECT c_custkey AS doc_key, i AS win, (i * 40)::INT AS s, CASE WHEN i = 3 THEN 190 ELSE (i * 40 + 50 + c_custkey % 15)::INT END AS e FROM customer, range(4) AS r(i))"
LABELS = "l AS (SELECT c_custkey AS doc_key, i AS win, p AS pos, CASE WHEN (p + c_custkey) % 3 = 0 THEN 'B-TOOLS' ELSE 'I-TOOLS' END AS label FROM customer, range(4) AS r(i), range(190) AS q(p) WHERE p >= i * 40 AND p < CASE WHEN i = 3 THEN 190 ELSE i * 40 + 50 + c_custkey % 15 END AND (p * 7 + i * 3 + c_custkey) % (2 + c_custkey % 5) > 0)"


def fake_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Windows of 190 words in four parts, and labels, by arithmetic on customers."""
    win = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_key"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("win"))
    end = F.when(F.col("win") == 3, 190).otherwise((F.col("win") * 40 + 50 + F.col("doc_key") % 15).cast("int"))
    win = win.select("doc_key", "win", (F.col("win") * 40).alias("start"), end.alias("end"))
    pos = win.withColumn("pos", F.explode(F.sequence("start", F.col("end") - 1)))
    pos = pos.filter((F.col("pos") * 7 + F.col("win") * 3 + F.col("doc_key")) % (2 + F.col("doc_key") % 5) > 0)
    label = F.when((F.col("pos") + F.col("doc_key")) % 3 == 0, "B-TOOLS").otherwise("I-TOOLS")
    return win, pos.select("doc_key", "win", "pos", label.alias("label"))


SEAMS = f"""WITH {WINDOWS}, {LABELS}, b AS (SELECT doc_key, win, lead(s) OVER (PARTITION BY doc_key ORDER BY win) AS lo, e AS hi FROM w),
m AS (SELECT *, (lo + hi) // 2 AS mid, least({C.SEAM_RADIUS}, (hi - lo) // 4) AS r FROM b WHERE lo IS NOT NULL),
c AS (SELECT m.doc_key, m.win, mid, p AS pos FROM m, range(190) AS q(p) WHERE p BETWEEN mid - r AND mid + r AND p >= lo AND p < hi
  AND NOT EXISTS (SELECT 1 FROM l WHERE l.doc_key = m.doc_key AND l.pos = p AND l.win IN (m.win, m.win + 1))),
k AS (SELECT m.doc_key, m.win, coalesce(arg_min(c.pos, (abs(c.pos - c.mid), c.pos)), any_value(m.mid)) AS cut FROM m LEFT JOIN c USING (doc_key, win) GROUP BY m.doc_key, m.win),
cuts AS (SELECT doc_key, win, max(cut) OVER (PARTITION BY doc_key ORDER BY win) AS cut FROM k)"""


@query(f"{SEAMS} SELECT doc_key, win, cut FROM cuts")
def seam_snap(spark, sf_dir):
    return sequence.seams(*fake_windows(spark, sf_dir))


MERGED = f"{SEAMS}, o AS (SELECT doc_key, win, coalesce(lag(cut) OVER (PARTITION BY doc_key ORDER BY win), s) AS lo, coalesce(cut, e) AS hi FROM w LEFT JOIN cuts USING (doc_key, win)), merged AS (SELECT doc_key, pos, label FROM l JOIN o USING (doc_key, win) WHERE pos >= lo AND pos < hi)"


@query(f"{MERGED} SELECT doc_key, pos, label FROM merged")
def merge_labels(spark, sf_dir):
    return sequence.merge_labels(*fake_windows(spark, sf_dir))


RUNS = """r1 AS (SELECT *, lower(substr(label, 3)) AS category, lag(pos) OVER v AS bp, lag(lower(substr(label, 3))) OVER v AS bc FROM {src} WINDOW v AS (PARTITION BY doc_key ORDER BY pos)),
r2 AS (SELECT *, sum(CASE WHEN bp = pos - 1 AND bc = category AND label LIKE 'I-%' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_key ORDER BY pos) AS run FROM r1)"""
BIO_TOKENS = f"""t AS (SELECT conv_id * 100 + turn AS doc_key, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT conv_id, turn, {O.tokens('text')} AS w FROM conversations)),
lab AS (SELECT doc_key, pos, word, CASE (pos * 5 + doc_key) % 7 WHEN 0 THEN 'B-TOOLS' WHEN 1 THEN 'I-TOOLS' WHEN 2 THEN 'I-TOOLS' WHEN 3 THEN 'I-SOFTSKILL' WHEN 4 THEN 'B-SOFTSKILL' ELSE 'O' END AS label FROM t),
named AS (SELECT * FROM lab WHERE label <> 'O'), {RUNS.format(src='named')}"""


def bio_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_key"), "text")
    k = (F.col("pos") * 5 + F.col("doc_key")) % 7
    label = F.when(k == 0, "B-TOOLS").when((k == 1) | (k == 2), "I-TOOLS").when(k == 3, "I-SOFTSKILL").when(k == 4, "B-SOFTSKILL").otherwise("O")
    return sequence.tokens(docs).withColumn("label", label)


@query(f"WITH {BIO_TOKENS} SELECT doc_key, category, min(pos)::INT AS ord, string_agg(word, ' ' ORDER BY pos) AS span FROM r2 GROUP BY doc_key, category, run")
def bio_group(spark, sf_dir):
    return sequence.group_words(bio_tokens(spark, sf_dir).withColumn("glued", F.lit(False)))


@query(f"WITH g AS (SELECT doc_id, regexp_extract_all(text, '[{O.SPACES}]*(?:{O.TOKEN})') AS t FROM documents), r AS (SELECT doc_id, t, unnest(range(1, len(t)))::INT AS i FROM g) SELECT doc_id, i - 1 AS pos FROM r WHERE regexp_matches(t[i], '^[{O.SPACES}]*[.]$') AND NOT regexp_matches(t[i + 1], '^[{O.SPACES}]')")
def dot_glue(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.dot_glue(F.col("text"))).alias("pos", "glued"))
    return rows.filter("glued").select("doc_id", "pos")


TRIMMED = f"""tr AS (SELECT doc_key, category, ord, list_transform(w, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS marks, w FROM (SELECT doc_key, category, min(pos)::INT AS ord, list(word ORDER BY pos) AS w FROM r2 GROUP BY doc_key, category, run)),
tp AS (SELECT doc_key, category, ord, CASE WHEN list_position(marks, true) IS NULL OR list_position(marks, true) = 0 THEN '' ELSE array_to_string(w[list_position(marks, true) : len(w) - list_position(list_reverse(marks), true) + 1], ' ') END AS span FROM tr)"""


@query(f"WITH {BIO_TOKENS}, {TRIMMED} SELECT doc_key, category, ord, span FROM tp")
def trim_punct(spark, sf_dir):
    spans = sequence.group_words(bio_tokens(spark, sf_dir).withColumn("glued", F.lit(False)))
    return spans.withColumn("span", T.trim_edge_punctuation(F.col("span")))


@query(f"WITH {BIO_TOKENS}, {TRIMMED} SELECT doc_key, category, ord, span FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, category, lower(span) ORDER BY ord) AS n FROM tp WHERE span <> '') WHERE n = 1")
def dedupe_spans(spark, sf_dir):
    return sequence.clean_spans(sequence.group_words(bio_tokens(spark, sf_dir).withColumn("glued", F.lit(False))))


@query("SELECT e.vec_id, (SELECT min(i) FROM range(len(e.embedding)) AS r(i) WHERE e.embedding[i + 1] = list_max(e.embedding))::INT AS best FROM embeddings e")
def argmax_scores(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", sequence.argmax(F.col("embedding")).alias("best"))


@query(f"""WITH {LENGTHS}, e AS (SELECT doc_id, flatten(list_transform(range(n), lambda i: CASE WHEN l[i + 1] > 0 THEN list_concat([(i % 13)::INT], list_resize([]::INT[], l[i + 1] - 1, {C.IGNORED_LABEL})) ELSE []::INT[] END)) AS f FROM len_n)
  SELECT doc_id, array_to_string(list_resize(list_concat(list_concat([{C.IGNORED_LABEL}]::INT[], f[1 : 62]), [{C.IGNORED_LABEL}]::INT[]), 64, {C.IGNORED_LABEL}), ',') AS labels FROM e""")
def align_labels(spark, sf_dir):
    rows = token_docs(spark, sf_dir)
    labels = F.transform("lengths", lambda _, i: (i % 13).cast("int"))
    aligned = sequence.align_labels(labels, F.col("lengths"), 64)
    return rows.select(F.col("doc_key").alias("doc_id"), F.array_join(F.transform(aligned, lambda x: x.cast("string")), ",").alias("labels"))


# --- samples and metrics --------------------------------------------------------------------------------------

TEMPLATES = values(datagen.template_table(), "tt(template, seg, literal, type, n, size)")
VOCAB = values(datagen.vocabulary_table(), "vt(type, idx, value)")
SAMPLES = f"""s0 AS (SELECT c_custkey AS id, c_custkey + {C.DATAGEN_SEED} AS x FROM customer), s1 AS (SELECT id, x, unnest(range(CASE WHEN (x * 37) % 100 < {C.MULTI_SHARE} THEN 2 + x % 2 ELSE 1 END)) AS sentence FROM s0),
s2 AS (SELECT s1.*, tt.* FROM s1 JOIN {TEMPLATES} ON template = (x * 7 + sentence * 11) % {len(C.TEMPLATES)}),
s3 AS (SELECT *, unnest(range(n)) AS j FROM s2 WHERE type IS NOT NULL),
s4 AS (SELECT s3.*, value FROM s3 JOIN {VOCAB} ON vt.type = s3.type AND vt.idx = (x * 31 + sentence * 17 + seg * 13 + j * (1 + x % greatest((size - 1) // 2, 1))) % size),
s5 AS (SELECT id, sentence, seg, j, list_concat(CASE WHEN j = 0 THEN [] WHEN n = 2 THEN ['and O'] WHEN j = n - 1 THEN [', O', 'and O'] ELSE [', O'] END,
    list_transform({O.tokens('value')}, lambda w, i: w || CASE WHEN i = 1 THEN ' B-' ELSE ' I-' END || type)) AS t FROM s4
  UNION ALL SELECT id, sentence, seg, 0, list_transform({O.tokens('literal')}, lambda w: w || ' O') FROM s2 WHERE literal IS NOT NULL),
samples AS (SELECT id, flatten(list(t ORDER BY sentence, seg, j)) AS t FROM s5 GROUP BY id)"""
NAMES = values(list(enumerate(C.LABELS)), "nm(label_id, label)")
#: Labelled samples made of the turns of conversations: a word's label is worked out from its place.
TURNS = f"""samples AS (SELECT id, t FROM (SELECT conv_id * 100 + turn AS id, list_transform({O.tokens('text')}, lambda w, i: w || ' ' ||
  CASE WHEN ((i - 1) * (i - 1) + conv_id * 100 + turn) % 17 < {len(C.LABELS)} THEN [{O.listed(C.LABELS)}][((i - 1) * (i - 1) + conv_id * 100 + turn) % 17 + 1] ELSE 'O' END) AS t FROM conversations) WHERE len(t) > 0)"""


def turn_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, words, labels): `TURNS`."""
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), T.tokenize(F.col("text")).alias("words"))
    k = lambda i: (i.cast("long") * i + F.col("id")) % 17
    labels = F.transform("words", lambda _, i: F.when(k(i) < len(C.LABELS), k(i)).otherwise(0).cast("int"))
    return rows.filter(F.size("words") > 0).select("id", "words", labels.alias("labels"))


@query(f"WITH {SAMPLES} SELECT id, len(t) AS n_tokens, array_to_string(t, chr(10)) AS lines FROM samples")
def datagen_samples(spark, sf_dir):
    names = F.array(*map(F.lit, C.LABELS))
    """A sample for each customer's number."""
    rows = datagen.generate_for(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))
    lines = F.array_join(F.zip_with("words", "labels", lambda w, i: F.concat(w, F.lit(" "), F.get(names, i))), "\n")
    return rows.select("id", F.size("words").alias("n_tokens"), lines.alias("lines"))


@query(f"""WITH {TURNS}, lines AS (SELECT md5(array_to_string(t, chr(10))) AS sample_md5, len(t) AS n FROM samples) SELECT sample_md5, n AS n_words, count(*) AS n_samples FROM lines GROUP BY 1, 2""")
def conll_round_trip(spark, sf_dir):
    """Samples as lines, read as a file's lines are."""
    names = F.array(*map(F.lit, C.LABELS))
    name = F.concat_ws(":", F.col("id").cast("string"), F.monotonically_increasing_id().cast("string"))  # ids may repeat or be null
    made = turn_samples(spark, sf_dir).withColumn("path", name)
    text = conll.sample_text(F.col("words"), F.transform("labels", lambda i: F.get(names, i)))
    lines = made.select("path", F.posexplode(F.split(F.concat(F.lit("\n"), text, F.lit("\n")), "\n")).alias("at", "line"))
    back = conll.samples_of(lines.select("path", (F.col("at") + 1).alias("line_no"), "line"))
    joined = F.array_join(F.zip_with("words", "labels", lambda w, i: F.concat(w, F.lit(" "), F.get(names, i))), "\n")
    return back.groupBy(F.md5(joined.cast("binary")).alias("sample_md5"), F.size("words").alias("n_words")).agg(F.count("*").alias("n_samples"))


@query(f"""WITH {TURNS}, c AS (SELECT label, count(*) AS n FROM (SELECT split_part(unnest(t), ' ', 2) AS label FROM samples) GROUP BY 1)
  SELECT label_id, round(coalesce((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 1.0), 9) AS weight FROM {NAMES} LEFT JOIN c USING (label)""")
def class_weights(spark, sf_dir):
    return metrics.class_weights(turn_samples(spark, sf_dir)).select("label_id", F.round("weight", 9).alias("weight"))


GOLD = f"""gold AS (SELECT id AS doc_key, unnest(range(len(t))) AS pos, split_part(unnest(t), ' ', 2) AS label FROM samples),
guess AS (SELECT doc_key, pos, CASE WHEN (doc_key + pos) % 9 = 0 THEN 'O' WHEN (doc_key * 3 + pos) % 11 = 0 THEN 'B-TOOLS' ELSE label END AS label FROM gold)"""


def ends(name: str, src: str) -> str:
    runs = RUNS.format(src=f"(SELECT * FROM {src} WHERE label <> 'O')").replace("r1 AS", f"{name}1 AS").replace("r2 AS", f"{name}2 AS").replace("FROM r1", f"FROM {name}1")
    return f"{runs}, {name} AS (SELECT doc_key, category, min(pos) AS s, max(pos) AS e FROM {name}2 GROUP BY doc_key, category, run)"


COUNTS = f"""WITH {TURNS}, {GOLD}, {ends('ge', 'gold')}, {ends('pe', 'guess')}, counts AS (SELECT coalesce(ge.category, pe.category) AS name, count(ge.s) AS t, count(pe.s) AS p, count(ge.s + pe.s) AS b
  FROM ge FULL JOIN pe ON ge.doc_key = pe.doc_key AND ge.category = pe.category AND ge.s = pe.s AND ge.e = pe.e GROUP BY 1)"""
PRF = "coalesce(b / nullif(p, 0), 0) AS precision, coalesce(b / nullif(t, 0), 0) AS recall, coalesce(2.0 * b / nullif(p + t, 0), 0) AS f1"


def gold_and_guess(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    names = F.array(*map(F.lit, C.LABELS))
    rows = turn_samples(spark, sf_dir).select(F.col("id").alias("doc_key"), F.posexplode("labels").alias("pos", "l"))
    gold = rows.select("doc_key", "pos", F.get(names, F.col("l")).alias("label"))
    x, p = F.col("doc_key"), F.col("pos")
    wrong = F.when((x + p) % 9 == 0, "O").when((x * 3 + p) % 11 == 0, "B-TOOLS").otherwise(F.col("label"))
    return gold, gold.withColumn("label", wrong)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"{COUNTS}, a AS (SELECT sum(t) AS t, sum(p) AS p, sum(b) AS b FROM counts) SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM (SELECT {PRF} FROM a)")
def entity_prf(spark, sf_dir):
    return rounded(metrics.entity_scores(*gold_and_guess(spark, sf_dir)))


@query(f"""{COUNTS}, s AS (SELECT name, {PRF}, t AS support FROM counts), a AS (SELECT sum(t) AS t, sum(p) AS p, sum(b) AS b FROM counts),
  u AS (SELECT * FROM s UNION ALL SELECT 'micro avg', {PRF}, t FROM a UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM s
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM s)
  SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM u""")
def entity_report(spark, sf_dir):
    return rounded(metrics.entity_report(*gold_and_guess(spark, sf_dir)))


@query(f"WITH {LENGTHS} SELECT least({C.MOST_SUBWORDS}, floor(quantile_cont(n, 0.95)))::INT AS max_len FROM len_n")
def max_len_p95(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.size(T.tokenize(F.col("text"))).alias("n"))
    return metrics.max_length(rows)


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS t FROM orders)
  SELECT o_orderkey, CASE WHEN i < floor(t * 0.8) THEN 'train' WHEN i < floor(t * 0.8) + floor(t * 0.1) THEN 'validation' ELSE 'test' END AS part FROM n""")
def sequential_split(spark, sf_dir):
    return metrics.sequential_split(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT event_type AS tag, count(*) AS n FROM events WHERE event_type <> 'O' GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 10")
def frequent_unknown_tags(spark, sf_dir):
    lines = read(spark, sf_dir, "events").select(F.lit("f").alias("path"), F.col("event_id").alias("line_no"), F.concat(F.lit("token "), "event_type").alias("line"))
    return conll.frequent_unknown_tags(conll.diagnostics(lines))


# --- files, splits, rules -------------------------------------------------------------------------------------


@query(ORACLE_SQL["conll_round_trip"])
def conll_files(spark, sf_dir):
    """Samples written as files in the shared folder and read back."""
    path = fresh_path(spark, "conll")
    conll.write_conll(turn_samples(spark, sf_dir), path)
    back = conll.load_conll(spark, f"{path}/*.txt")
    names = F.array(*map(F.lit, C.LABELS))
    joined = F.array_join(F.zip_with("words", "labels", lambda w, i: F.concat(w, F.lit(" "), F.get(names, i))), "\n")
    return back.groupBy(F.md5(joined.cast("binary")).alias("sample_md5"), F.size("words").alias("n_words")).agg(F.count("*").alias("n_samples"))


@query("SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 10000 < 1000 THEN 'validation' ELSE 'train' END AS part FROM orders")
def hashed_split(spark, sf_dir):
    return metrics.hashed_split(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(f"WITH {TURNS} SELECT count(*) AS samples, sum(len(t))::BIGINT AS tokens FROM samples")
def corpus_totals(spark, sf_dir):
    return datagen.totals(turn_samples(spark, sf_dir))


@query(f"""WITH {TURNS}, g AS (SELECT id, [{O.listed(C.LABELS)}] AS names, list_filter(list_transform(t, lambda x, i: {{'l': split_part(x, ' ', 2), 'i': i - 1}}), lambda z: (id + z.i) % 5 <> 0) AS z FROM samples)
  SELECT id, array_to_string(list_transform(z, lambda x: x.l), ' ') AS gold, array_to_string(list_transform(z, lambda x: names[(list_position(names, x.l) - 1 + x.i) % {len(C.LABELS)} + 1]), ' ') AS predicted FROM g""")
def label_sequences(spark, sf_dir):
    """Every fifth label is ignored; predictions are the labels moved on by their place."""
    rows = turn_samples(spark, sf_dir)
    labels = F.transform("labels", lambda x, i: F.when((F.col("id") + i) % 5 == 0, C.IGNORED_LABEL).otherwise(x))
    guesses = F.transform("labels", lambda x, i: ((x + i) % len(C.LABELS)).cast("int"))
    rows = rows.select("id", labels.alias("labels"), guesses.alias("guesses"))
    gold, predicted = metrics.to_label_sequences(F.col("labels"), F.col("guesses"))
    return rows.select("id", F.array_join(gold, " ").alias("gold"), F.array_join(predicted, " ").alias("predicted"))


#: Every thirty-first word's line is spoilt in one of four ways.
SPOILT = f"""WITH {TURNS}, w AS (SELECT split_part(x, ' ', 2) AS tag, ((i - 1) * 3 + id) % 31 AS k FROM (SELECT id, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS i FROM samples)),
c AS (SELECT count(*) + (SELECT count(*) FROM samples) AS lines, count_if(k = 2)::BIGINT AS edge_lines, count_if(k = 0)::BIGINT AS malformed_lines, count_if(k = 3)::BIGINT AS interior_fields,
  count_if(k = 1)::BIGINT AS unknown_tags, count_if(k > 0)::BIGINT AS words, count_if(k > 1 AND tag <> 'O')::BIGINT AS entity_words FROM w)"""


@query(f"{SPOILT} SELECT *, CASE WHEN words = 0 THEN CASE WHEN malformed_lines > 0 THEN 'all_malformed' ELSE 'empty' END WHEN entity_words = 0 THEN 'all_o' END AS verdict FROM c")
def conll_summary(spark, sf_dir):
    """Spoilt files read leniently: what the reading pass counts on its way, and what it says of the files."""
    names = F.array(*map(F.lit, C.LABELS))
    line = lambda w, tag, k: (
        F.when(k == 0, F.concat(w, F.lit(" O more")))
        .when(k == 1, F.concat(w, F.lit(" B-HOBBY")))
        .when(k == 2, F.concat(w, F.lit("\u00ad "), tag))
        .when(k == 3, F.concat(F.lit("x\u200b"), w, F.lit(" "), tag))
        .otherwise(F.concat(w, F.lit(" "), tag))
    )
    pairs = F.arrays_zip(F.col("words").alias("w"), F.col("labels").alias("l"))
    lines = F.transform(pairs, lambda z, i: line(z["w"], F.get(names, z["l"]), (i * 3 + F.col("id")) % 31))
    path = fresh_path(spark, "conll")
    turn_samples(spark, sf_dir).select(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value")).write.text(path)
    found = conll.parse(spark, f"{path}/*.txt", strict=False)[1]
    schema = ", ".join(f"{c} long" for c in conll.COUNTERS)
    return spark.createDataFrame([(*[found[c] for c in conll.COUNTERS], conll.verdict(found))], f"{schema}, verdict string")


@query(f"WITH {O.SPANS_SQL}, c AS (SELECT CASE doc_key % 10 WHEN 0 THEN 'hobby' WHEN 1 THEN 'language' ELSE category END AS category FROM jd_spans) SELECT category, count(*) AS n FROM c WHERE category NOT IN ({O.listed(C.CATEGORIES)}) GROUP BY category")
def unknown_categories(spark, sf_dir):
    k = F.col("doc_key") % 10
    spans = Inputs(spark, sf_dir).jd_spans.withColumn("category", F.when(k == 0, "hobby").when(k == 1, "language").otherwise(F.col("category")))
    return matching.unknown_categories(spans)


@query(f"""WITH {O.SPANS_SQL}, b AS (SELECT doc_key, string_agg('  ' || label || ':' || chr(10) || items, chr(10) ORDER BY n) AS body FROM (SELECT doc_key, category, string_agg('    - ' || span, chr(10) ORDER BY ord, span) AS items FROM jd_spans GROUP BY 1, 2) JOIN {REPORT_ORDER} USING (category) GROUP BY 1)
  SELECT doc_key, md5('=== Job description ===' || chr(10) || body) AS block_md5 FROM b""")
def entity_blocks(spark, sf_dir):
    rows = compose.grouped(Inputs(spark, sf_dir).jd_spans, "doc_key")
    return rows.select("doc_key", F.md5(compose.entities_block("Job description", F.col("items")).cast("binary")).alias("block_md5"))


@query(f"""{ANALYSIS}, l AS ({label_lines(C.MAIL_LABELS, 'gaps', 'pair_id', '  • ')}), made AS (SELECT pair_id, problem, CASE WHEN pair_id % 3 = 0 THEN 'Draft for ' || pair_id END AS generated FROM analysis)
  SELECT pair_id, CASE WHEN problem IS NULL THEN md5(coalesce(generated, {MAIL_HEAD} || coalesce({said(C.MAIL['gaps'])} || chr(10) || chr(10) || lines || chr(10) || chr(10) || {said(C.MAIL['advice'])}, {said(C.MAIL['none'])}) || {MAIL_TAIL})) END AS feedback_md5,
  CASE WHEN problem IS NULL AND generated IS NULL THEN 1 ELSE 0 END AS n_notices, pair_id % 2 = 0 AND NOT pair_id % 5 = 0 AND problem IS NULL AS downloadable FROM made LEFT JOIN l USING (pair_id)""")
def feedback_rules(spark, sf_dir):
    """Generated texts where there are some, else the template; what may leave."""
    key = F.col("pair_id")
    generated = F.when(key % 3 == 0, F.concat(F.lit("Draft for "), key.cast("string")))
    rows = analysis.write_feedback(analysed(spark, sf_dir), generated)
    may_leave = analysis.downloadable(key % 2 == 0, key % 5 == 0, F.col("problem"))
    return rows.select("pair_id", F.md5(F.col("feedback").cast("binary")).alias("feedback_md5"), F.size("notices").alias("n_notices"), may_leave.alias("downloadable"))


DRIFT = [quoted(x) for x in C.SETTINGS_CHANGED]


@query(f"""SELECT c_custkey AS pair_id, changed AS settings_changed, CASE WHEN changed THEN {DRIFT[0]} || role || {DRIFT[1]} || company || {DRIFT[2]} || recruiter || {DRIFT[3]} || mode || {DRIFT[4]} END AS message
  FROM (SELECT *, NOT (role = now_role AND company = now_company AND recruiter = now_recruiter AND mode = now_mode) AS changed FROM (
  SELECT c_custkey, c_mktsegment AS role, n_name AS company, c_name AS recruiter, 'Template' AS mode, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'Analyst' END AS now_role,
    CASE WHEN c_custkey % 3 = 0 THEN 'Elsewhere' ELSE n_name END AS now_company, c_name AS now_recruiter, CASE WHEN c_custkey % 5 = 0 THEN 'Model' ELSE 'Template' END AS now_mode FROM customer JOIN nation ON c_nationkey = n_nationkey))""")
def settings_drift(spark, sf_dir):
    """Drafts whose settings are no longer the current ones."""
    people = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 rows
    k = F.col("c_custkey")
    then = F.struct(F.col("c_mktsegment").alias("role"), F.col("n_name").alias("company"), F.col("c_name").alias("recruiter"), F.lit("Template").alias("mode"))
    now = F.struct(
        F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("Analyst").alias("role"), F.when(k % 3 == 0, "Elsewhere").otherwise(F.col("n_name")).alias("company"),
        F.col("c_name").alias("recruiter"), F.when(k % 5 == 0, "Model").otherwise("Template").alias("mode"),
    )
    drafts = people.select(k.alias("pair_id"), then.alias("settings"), now.alias("current"))
    rows = analysis.with_settings_notice(drafts, F.col("current"))
    return rows.select("pair_id", "settings_changed", F.col("settings_notice").alias("message"))


# --- whole texts to spans -------------------------------------------------------------------------------------


#: Postings and candidates as texts, of the spans that the tables give; no dot is flush with a word in them. Even keys are
#: postings, odd ones candidates.
WRITTEN = f"""SELECT doc_key * 2 AS doc_key, string_agg(replace(span, '.NET', 'NET'), ' ; ' ORDER BY ord, category, span) AS text FROM jd_spans GROUP BY 1
  UNION ALL SELECT doc_key * 2 + 1, string_agg(replace(span, '.NET', 'NET'), ' ; ' ORDER BY ord, category, span) FROM resume_spans GROUP BY 1"""
#: Their spans: each window of a term is an entity of the term's type, without words of punctuation at its ends; of a
#: document's spans equal but for case the first stays.
EXTRACTED = f"""docs AS (WITH {O.SPANS_SQL} {WRITTEN}), voc_raw AS (SELECT * FROM {values(raw_vocabulary(), 'vr(raw, type, rank)')}), {O.canonical('voc_c', 'voc_raw')},
voc AS (SELECT canon AS term, arg_min(type, rank) AS type FROM voc_raw JOIN voc_c USING (raw) GROUP BY canon),
toks AS (SELECT doc_key, {O.tokens('text')} AS all_w FROM docs), {O.recognised('hit', 'toks', 'doc_key', 'all_w', 'voc')},
hit_words AS (SELECT doc_key, lower(type) AS category, i AS ord, all_w[i + 1 : i + k] AS w FROM hit JOIN toks USING (doc_key) JOIN voc USING (term)),
hit_marks AS (SELECT *, list_transform(w, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS marks FROM hit_words),
hit_spans AS (SELECT doc_key, category, ord, array_to_string(w[list_position(marks, true) : len(w) - list_position(list_reverse(marks), true) + 1], ' ') AS span FROM hit_marks),
spans AS (SELECT doc_key, category, ord, span FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, category, lower(span) ORDER BY ord) AS n FROM hit_spans) WHERE n = 1)"""


def written_texts(made: Inputs) -> DataFrame:
    """(doc_key, text): `WRITTEN`."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "category", "span"))), lambda x: F.replace(x["span"], F.lit(".NET"), F.lit("NET")))  # of one document
    text = lambda spans, odd: spans.groupBy((F.col("doc_key") * 2 + odd).cast("long").alias("doc_key")).agg(F.array_join(listed, " ; ").alias("text"))
    return text(made.jd_spans, 0).unionByName(text(made.resume_spans, 1))


@query(f"WITH {EXTRACTED} SELECT doc_key, category, ord, span FROM spans")
def extract_spans(spark, sf_dir):
    """Texts of both sides through the lexicon labeller."""
    return analysis.extract_spans(written_texts(Inputs(spark, sf_dir)))


@query(f"WITH {EXTRACTED} SELECT doc_key, category, ord, span FROM spans")
def windowed_spans(spark, sf_dir):
    """The same window by window: words whose labels come from a window in whose middle they are."""
    return analysis.extract_spans(written_texts(Inputs(spark, sf_dir)), windowed(lexicon_labeller, BUDGET))


SIDES = f"""{EXTRACTED}, jd_spans AS (SELECT * FROM spans), resume_spans AS (SELECT * FROM spans), jd_docs AS (SELECT * FROM docs), resume_docs AS (SELECT * FROM docs),
pairs AS (WITH {O.SPANS_SQL} SELECT pair_id, jd_key * 2 AS jd_key, resume_key * 2 + 1 AS resume_key FROM pairs)"""


@query(f"{analysis_sql(O.facts(SIDES))} SELECT pair_id, problem, missing, array_to_string(notes, ' / ') AS notes FROM analysis")
def analyze_texts(spark, sf_dir):
    """Texts of both sides through labeller, gate, gaps and notes."""
    made = Inputs(spark, sf_dir)
    docs = written_texts(made)
    pairs = made.pairs.select("pair_id", (F.col("jd_key") * 2).cast("long").alias("jd_key"), (F.col("resume_key") * 2 + 1).cast("long").alias("resume_key"))
    items = F.array_join(F.transform("missing", lambda x: F.concat(x["category"], F.lit(":"), x["span"])), "|")
    return analysis.analyze(pairs, docs).select("pair_id", "problem", items.alias("missing"), F.array_join("notes", " / ").alias("notes"))


@query()
def classifier_report(spark, sf_dir):
    """A token classifier learns what the lexicon labeller says of both sides' texts; its entities on the texts it has not
    seen, by category."""
    docs = written_texts(Inputs(spark, sf_dir))
    samples = materialize(labelled_samples(docs), "samples")
    held = F.pmod(F.crc32(F.col("doc_key").cast("string").cast("binary")), F.lit(7)) == 0
    model, _ = train_token_classifier(samples.filter(~held), grid=(0.001,), features=1 << 12, stride=4)
    unseen = samples.filter(held)
    names = F.array(*map(F.lit, C.LABELS))
    gold = unseen.select("doc_key", F.posexplode("labels").alias("pos", "l")).select("doc_key", "pos", F.get(names, F.col("l")).alias("label"))
    guess = classifier_labeller(model)(unseen.select("doc_key", F.array_join("words", " ").alias("text")))
    return rounded(metrics.entity_report(gold, guess.select("doc_key", "pos", "label")))
