"""Postings and candidates made from the tables, so that spans, pairs and texts are at hand at any scale.

A part is a posting, a customer a candidate, and who ordered a part applied for it. The SQL is plain enough for
any engine; the surfaces are vocabulary terms, some written otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gapline import constants as C
from gapline.operators.lexicon import SKILL_SOURCES
from gapline.session import materialize, ship_package

VARIANTS = ["Amazon Web Services", "a.w.s", "K8s", "ML", "NLP", "torch", "node", "CI/CD pipelines", "python", "DOCKER", "REST API", "Golang", "Postgres", "sklearn", "production ML systems", "C++ 11"]


def category_of(term: str) -> str:
    return "tools" if term in C.TOOLS else "softskill" if term in C.SOFT_SKILLS else "technicalskill"


SURFACES = [(i, category_of(t), t) for i, t in enumerate(SKILL_SOURCES + VARIANTS)]
TITLES = list(enumerate(C.QUALIFICATIONS))


def quoted(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else "NULL" if value is None else str(value)


def values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS {names}"


#: {part}, {customer}, {orders} and {lineitem} stand for the tables.
SPANS_TEMPLATE = f"""
surfaces AS (SELECT * FROM {values(SURFACES, "s(idx, category, surface)")}),
titles AS (SELECT * FROM {values(TITLES, "t(idx, surface)")}),
slots AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) AS r(j)),
jd_spans AS (
  SELECT p_partkey AS doc_key, category, j AS ord, surface AS span
  FROM {{part}} JOIN slots ON j < 3 + p_partkey % 4 JOIN surfaces ON idx = (p_partkey * 7 + j * 31) % {len(SURFACES)}
  UNION ALL
  SELECT p_partkey, 'yearofexperience', 10, CASE p_partkey % 5 WHEN 0 THEN concat(CAST(p_size AS VARCHAR(9)), ' months')
    WHEN 1 THEN concat(CAST(1 + p_partkey % 4 AS VARCHAR(9)), '-', CAST(5 + p_partkey % 4 AS VARCHAR(9)), ' years')
    WHEN 2 THEN 'five to ten years' ELSE concat(CAST(1 + p_partkey % 12 AS VARCHAR(9)), '+ years') END FROM {{part}} WHERE p_partkey % 7 < 5
  UNION ALL
  SELECT p_partkey, 'qualification', 11, surface FROM {{part}} JOIN titles ON idx = p_partkey % {len(TITLES)} WHERE p_partkey % 3 > 0
  UNION ALL
  SELECT p_partkey, 'tools', 12, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'related field' END FROM {{part}} WHERE p_partkey % 5 = 0
  UNION ALL
  SELECT p_partkey, 'qualification', 13, 'good standing' FROM {{part}} WHERE p_partkey % 11 = 0
  UNION ALL
  SELECT p_partkey, 'designation', 14, 'Software Engineer' FROM {{part}}),
resume_spans AS (
  SELECT o_custkey AS doc_key, category, CAST(o_orderkey AS INT) AS ord, surface AS span
  FROM {{orders}} JOIN surfaces ON idx = (o_orderkey * 11) % {len(SURFACES)}
  UNION ALL
  SELECT c_custkey, 'yearofexperience', 0, CASE c_custkey % 5 WHEN 0 THEN 'October 2018 to Present'
    WHEN 1 THEN concat(CAST(c_custkey % 15 AS VARCHAR(9)), ' years 6 months') ELSE concat(CAST(c_custkey % 9 AS VARCHAR(9)), ' years') END
  FROM {{customer}} WHERE c_custkey % 6 > 0
  UNION ALL
  SELECT c_custkey, 'qualification', 0, surface FROM {{customer}} JOIN titles ON idx = (c_custkey * 13) % {len(TITLES)} WHERE c_custkey % 4 > 0),
pairs AS (SELECT DISTINCT o_custkey * 1000000 + l_partkey AS pair_id, l_partkey AS jd_key, o_custkey AS resume_key
          FROM {{orders}} JOIN {{lineitem}} ON o_orderkey = l_orderkey WHERE l_linenumber <= 2),
jd_docs AS (SELECT p_partkey AS doc_key, CASE p_partkey % 9 WHEN 0 THEN repeat('---- ', 20) WHEN 1 THEN '' WHEN 2 THEN repeat('<#/@> x9$ ', 8)
            WHEN 3 THEN NULL ELSE concat('Must know ', p_name, ' and ', p_type) END AS text FROM {{part}}),
resume_docs AS (SELECT c_custkey AS doc_key, CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN repeat('plain words here ', 20)
                ELSE concat('I am ', c_name, ' of segment ', c_mktsegment) END AS text FROM {{customer}})
"""
TABLES = ("part", "customer", "orders", "lineitem")
#: For engines that know the tables by name.
SPANS_SQL = SPANS_TEMPLATE.format(**{t: t for t in TABLES})


class Inputs:
    """The made tables of one folder as DataFrames. Each is written to the shared folder when it is first asked for, so
    that what reads it several times reads the tables below it once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_package(spark)
        self.spark, self.made = spark, {}
        self.tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = materialize(self.spark.sql(f"WITH {SPANS_TEMPLATE} SELECT * FROM {name}", **self.tables), name)
        return self.made[name]
