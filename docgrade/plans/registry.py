"""Every query by name, and the SQL that says the same.

Queries run over whole tables. SQL is given where it can express the result; where a figure is a
double, both sides round it once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pii
from ..functions import text as T
from ..operators import grading as G
from ..operators import mining as M
from ..operators import review as R
from ..operators import seeds as S
from ..operators import spans as P
from ..operators import taxonomy as X
from ..operators import vectors as V
from ..sources import extract
from .layout import dealt, sparing
from .policy import DEMO

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for queries that work on each of them at length."""
    return dealt(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- text

CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"SELECT doc_id, md5({CLEAN}) AS clean_md5, length({CLEAN}) AS n_clean FROM documents")
def clean_text_ascii(spark, sf_dir):
    t = T.clean_ascii(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(t.cast("binary")).alias("clean_md5"), F.length(t).cast("long").alias("n_clean"))


@query(f"SELECT doc_id, md5({CLEAN.replace('text,', 'nfc_normalize(text),', 1)}) AS clean_md5 FROM documents")
def nfc_clean(spark, sf_dir):
    sparing(spark)
    return documents(spark, sf_dir).select("doc_id", F.md5(T.clean(F.col("text")).cast("binary")).alias("clean_md5"))


@query(
    r"SELECT doc_id, trim(regexp_extract(text, '(?m)^(.*\S.*)$', 1)) AS first_line, length(substring(text, 1, 400)) AS n_head, md5(substring(text, 1, 400)) AS head_md5 FROM documents"
)
def head_and_title(spark, sf_dir):
    t, h = F.col("text"), T.head(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.first_line(t).alias("first_line"), F.length(h).cast("long").alias("n_head"), F.md5(h.cast("binary")).alias("head_md5")
    )


@query(r"SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) < 20 AS no_body, least(length(text), 2000000) AS n_kept, length(text) > 2000000 AS truncated FROM documents")
def no_body_flag(spark, sf_dir):
    kept = T.truncated(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.no_body(F.col("text")).alias("no_body"), F.length(kept["text"]).cast("long").alias("n_kept"), kept["truncated"].alias("truncated")
    )


def n_of(term: str, hay: str = "lower(text)") -> str:
    return f"CAST((length({hay}) - length(replace({hay}, '{term}', ''))) / {len(term)} AS BIGINT)"


@query(f"SELECT doc_id, {n_of('license')} AS n_license, {n_of('the')} AS n_the, {n_of('token')} AS n_token FROM documents")
def literal_count(spark, sf_dir):
    hay = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", *[T.count_literal(hay, t).cast("long").alias(f"n_{t}") for t in ("license", "the", "token")])


# a word's bounds in SQL: letters beyond ASCII are letters too
WORD_SQL = r"len(list_filter(regexp_split_to_array(lower(text), '[^\pL\pM\pN_]+'), lambda w: w = '{}'))"


@query(f"SELECT doc_id, {WORD_SQL.format('mit')} AS n_mit, {WORD_SQL.format('the')} AS n_the FROM documents")
def word_count(spark, sf_dir):
    hay = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", *[T.count_word(hay, t).cast("long").alias(f"n_{t}") for t in ("mit", "the")])


# 'licensed' holds 'license', so a hit counts only where no 'd' follows
@query(f"SELECT doc_id, {n_of('license')} - {n_of('licensed')} AS n FROM documents")
def exclude_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.count_outside(F.lower("text"), "license", ["licensed"]).cast("long").alias("n"))


@query(f"SELECT doc_id, t.term AS term, t.n AS n FROM (SELECT doc_id, unnest([{', '.join(f'''{{'term': '{t}', 'n': {n_of(t)}}}''' for t in ('license', 'token', 'rights', 'apache', 'password'))}]) AS t FROM documents) WHERE t.n > 0")
def term_scan(spark, sf_dir):
    found = T.term_counts(F.lower("text"), ["license", "token", "rights", "apache", "password"])
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(found)).select("doc_id", "term", F.col("count").cast("long").alias("n"))


# ---------------------------------------------------------------- personal data

EMAIL_SQL = r"list_filter(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}'), lambda x: NOT contains(x, '..') AND NOT starts_with(x, '.') AND NOT contains(x, '.@'))"
# versions and sections go first, so that what is left is judged by its own characters
NO_ADDRESS_SQL = rf"regexp_replace(regexp_replace(text, '(?i)(?:{pii.words(*pii.NO_ADDRESS_BEFORE)})\s*[.·:]?\s*(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}', 'x', 'g'), '(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?i:\s*(?:{pii.words(*pii.NO_ADDRESS_AFTER)}))', 'x', 'g')"
IP_SQL = r"""list_filter(regexp_extract_all(NO_ADDRESS, '(?:^|[^0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?:[^0-9.]|$)', 1), lambda x: len(list_filter(str_split(x, '.'), lambda o: CAST(o AS INT) > 255)) = 0
 AND CAST(str_split(x, '.')[1] AS INT) NOT IN (0, 127) AND CAST(str_split(x, '.')[1] AS INT) < 224 AND NOT starts_with(x, '169.254.') AND NOT starts_with(x, '192.0.2.') AND NOT starts_with(x, '198.51.100.') AND NOT starts_with(x, '203.0.113.'))""".replace("NO_ADDRESS", NO_ADDRESS_SQL)
LUHN = "list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[len(x) - i + 1] AS INT) ELSE CAST(x[len(x) - i + 1] AS INT) * 2 - CASE WHEN CAST(x[len(x) - i + 1] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
CARD_SQL = f"list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: len(x) BETWEEN 13 AND 19 AND x[1] IN ('2', '3', '4', '5', '6', '9') AND (len(x) <> 13 OR x[1] = '4') AND (len(x) <> 15 OR x[1:2] IN ('34', '37')) AND {LUHN})"


def _matches(label: str, sql: str):
    def run(spark, sf_dir):
        found = pii.DETECTORS[label].matches(F.col("text"))
        return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("value"))

    run.__name__ = {"EMAIL": "pii_email", "IP": "pii_ipv4", "CARD": "pii_card_luhn"}[label]
    query(f"SELECT doc_id, unnest({sql}) AS value FROM documents")(run)


_matches("EMAIL", EMAIL_SQL)
_matches("IP", IP_SQL)
_matches("CARD", CARD_SQL)


@query(
    r"SELECT page_id, len(regexp_extract_all(html, '(?i)https?://[^\s<>\"''`)\]}]*[^\s<>\"''`)\]}.,;:!?]')) AS n_in_html, len(regexp_extract_all(url, '(?i)https?://[^\s<>\"''`)\]}]*[^\s<>\"''`)\]}.,;:!?]')) AS n_in_url FROM pages"
)
def pii_url(spark, sf_dir):
    n = lambda c: F.size(pii.DETECTORS["URL"].hits(F.col(c))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n("html").alias("n_in_html"), n("url").alias("n_in_url"))


COUNTS_SQL = f"SELECT doc_id, lang, source, text, len({EMAIL_SQL}) AS n_email, len({IP_SQL}) AS n_ip, len({CARD_SQL}) AS n_card FROM documents"


def counted(spark, sf_dir, *keep: str) -> DataFrame:
    labels = {"EMAIL": "n_email", "IP": "n_ip", "CARD": "n_card"}
    return documents(spark, sf_dir).select("doc_id", *keep, *[F.size(pii.DETECTORS[k].hits(F.col("text"))).cast("long").alias(n) for k, n in labels.items()])


@query(
    f"WITH c AS ({COUNTS_SQL}), l AS (SELECT doc_id, 'EMAIL' AS label, n_email AS n FROM c UNION ALL SELECT doc_id, 'IP', n_ip FROM c UNION ALL SELECT doc_id, 'CARD', n_card FROM c) "
    "SELECT label, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM l WHERE n > 0 GROUP BY label"
)
def pii_counts_by_label(spark, sf_dir):
    long = counted(spark, sf_dir).selectExpr("stack(3, 'EMAIL', n_email, 'IP', n_ip, 'CARD', n_card) AS (label, n)")
    return long.filter("n > 0").groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))



@query()
def pii_span_resolution(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.inline(P.resolve(pii.detect(F.col("text")))))


@query(
    "SELECT doc_id, o AS offset, least(10000, least(length(text), 1000000) - o) AS n FROM (SELECT doc_id, text, unnest(range(0, greatest(least(length(text), 1000000) - 129, 0) + 1, 9872)) AS o FROM documents)"
)
def scan_windows(spark, sf_dir):
    return P.windows(table(spark, sf_dir, "documents")).select("doc_id", F.col("offset").cast("long").alias("offset"), F.length("piece").cast("long").alias("n"))


@query(
    """WITH s AS (SELECT conv_id, turn * 10 AS s, turn * 10 + 5 + (turn % 3) * 4 AS e FROM conversations),
 m AS (SELECT *, max(e) OVER (PARTITION BY conv_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
 SELECT conv_id, CAST(sum(CASE WHEN s >= coalesce(before, -1) THEN 1 ELSE 0 END) AS BIGINT) AS n_merged FROM m GROUP BY conv_id"""
)
def merged_spans(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn * 10 AS start", "turn * 10 + 5 + (turn % 3) * 4 AS end")
    return P.merged_count(c, "conv_id")


# ---------------------------------------------------------------- grading

GRADED_SQL = f"""WITH c AS ({COUNTS_SQL}), k AS (SELECT *, {n_of('license')} + {n_of('licensed')} AS n_k1, {n_of('token')} - {n_of('token ring')} + {n_of('password')} AS n_k2,
 {n_of('rights')} + {n_of('reserved')} + {n_of('license')} AS n_e1, {n_of('all rights reserved')} AS n_t1, strpos(lower(text), 'all rights reserved') AS p_t1, {n_of('gnu general public')} AS n_t2 FROM c),
 r AS (SELECT doc_id, source, list_max([
  CASE WHEN n_email >= 3 THEN 3 WHEN n_email > 0 THEN 2 ELSE 0 END, CASE WHEN n_ip >= 2 THEN 2 WHEN n_ip > 0 THEN 1 ELSE 0 END, CASE WHEN n_card > 0 THEN 3 ELSE 0 END,
  CASE WHEN n_email > 0 AND n_ip > 0 THEN 3 ELSE 0 END, CASE WHEN CAST(n_email > 0 AS INT) + CAST(n_ip > 0 AS INT) + CAST(n_card > 0 AS INT) >= 2 THEN 2 ELSE 0 END,
  CASE WHEN n_k1 >= 3 THEN 2 WHEN n_k1 > 0 THEN 1 ELSE 0 END, CASE WHEN n_k2 >= 2 THEN 3 WHEN n_k2 > 0 THEN 2 ELSE 0 END]) AS rule,
  CASE WHEN n_e1 >= 2 THEN 2 ELSE 0 END AS sensitive,
  greatest(CASE WHEN n_t1 >= 2 OR (p_t1 BETWEEN 1 AND 400) THEN 2 ELSE 0 END, CASE WHEN n_t2 > 0 THEN 1 ELSE 0 END) AS stamp FROM k),
 f AS (SELECT *, greatest(rule, sensitive, stamp) AS top FROM r),
 g AS (SELECT doc_id, source, CASE top WHEN 3 THEN 'C' WHEN 2 THEN 'S' WHEN 1 THEN 'O' END AS grade,
  array_to_string(list_filter([CASE WHEN top > 0 AND rule = top THEN 'rule' END, CASE WHEN top > 0 AND sensitive = top THEN 'sensitive' END, CASE WHEN top > 0 AND stamp = top THEN 'stamp' END], lambda x: x IS NOT NULL), ',') AS decided_by,
  CASE WHEN top > 0 THEN 'max' ELSE 'unclassified' END AS method FROM f) """


def graded(spark, sf_dir) -> DataFrame:
    """Graded documents; no document carries a name here, so the name signal is silent."""
    return G.graded(documents(spark, sf_dir), DEMO)


@query(GRADED_SQL + "SELECT coalesce(grade, 'none') AS grade, count(*) AS docs FROM g GROUP BY ALL")
def flagship_grade_counts(spark, sf_dir):
    return graded(spark, sf_dir).groupBy(F.coalesce("security.grade", F.lit("none")).alias("grade")).agg(F.count("*").alias("docs"))


@query(GRADED_SQL + "SELECT doc_id, grade, decided_by, method FROM g")
def fuse_max(spark, sf_dir):
    return graded(spark, sf_dir).select("doc_id", "security.grade", F.array_join("security.decided_by", ",").alias("decided_by"), "security.method")


@query(GRADED_SQL + "SELECT signal, count(*) AS docs FROM (SELECT unnest(str_split(decided_by, ',')) AS signal FROM g WHERE decided_by <> '') GROUP BY signal")
def decided_by_explode(spark, sf_dir):
    return graded(spark, sf_dir).select(F.explode("security.decided_by").alias("signal")).groupBy("signal").agg(F.count("*").alias("docs"))


@query()
def security_records(spark, sf_dir):
    return G.record(graded(spark, sf_dir), "doc_id", F.lit("2026-01-01 00:00:00"))


@query(f"SELECT doc_id, {n_of('license')} AS n, CASE WHEN {n_of('license')} >= 2 THEN 'S' ELSE 'O' END AS grade FROM documents WHERE {n_of('license')} > 0")
def bulk_escalation(spark, sf_dir):
    n = T.count_literal(F.lower("text"), "license")
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n"), G.escalated(n, "O", "S", 2).alias("grade")).filter("n > 0")


@query(f"SELECT doc_id, CASE WHEN {n_of('license')} >= 2 THEN {n_of('license')} ELSE 0 END + {n_of('password')} AS n FROM documents")
def min_count_rule(spark, sf_dir):
    hay = F.lower("text")
    n = T.count_literal(hay, "license")
    return table(spark, sf_dir, "documents").select("doc_id", (F.when(n >= 2, n).otherwise(0) + T.count_literal(hay, "password")).cast("long").alias("n"))


@query(
    f"SELECT doc_id, CASE WHEN p BETWEEN 1 AND 400 AND n >= 2 THEN 'head+repeat' WHEN p BETWEEN 1 AND 400 THEN 'head' WHEN n >= 2 THEN 'repeat' END AS mode, n FROM (SELECT doc_id, strpos(lower(text), 'license') AS p, {n_of('license')} AS n FROM documents) WHERE n > 0"
)
def stamp_mode(spark, sf_dir):
    mode, n = G.stamp_mode(F.lower("text"), ("license",))
    return table(spark, sf_dir, "documents").select("doc_id", mode.alias("mode"), n.cast("long").alias("n")).filter("n > 0")


@query(f"SELECT doc_id, {n_of('rights')} + {n_of('reserved')} + {n_of('license')} AS n FROM documents WHERE {n_of('rights')} + {n_of('reserved')} + {n_of('license')} >= 2")
def sensitive_min(spark, sf_dir):
    hay = F.lower("text")
    n = T.count_literal(hay, "rights") + T.count_literal(hay, "reserved") + T.count_literal(hay, "license")
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n")).filter("n >= 2")



@query(
    "SELECT least(CAST(floor(c / 0.2) AS INT), 4) AS bin, count(*) AS n FROM (SELECT (doc_id % 101) / 100.0::DOUBLE AS c FROM documents) GROUP BY ALL"
)
def confidence_bins(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(((F.col("doc_id") % 101) / F.lit(100.0)).alias("c"))
    return c.groupBy(R.confidence_bin(F.col("c")).alias("bin")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- document types

TREE_SQL = "tree(dc_id, parent) AS (VALUES ('A', NULL), ('A1', 'A'), ('A2', 'A'), ('A11', 'A1'), ('B', NULL), ('B1', 'B'), ('B2', 'B'))"
CLOSURE_SQL = f"{TREE_SQL}, up(dc_id, ancestor, distance) AS (SELECT dc_id, dc_id, 0 FROM tree UNION ALL SELECT u.dc_id, t.parent, u.distance + 1 FROM up u JOIN tree t ON t.dc_id = u.ancestor WHERE t.parent IS NOT NULL)"


def word(term: str, hay: str) -> str:
    return rf"len(regexp_extract_all({hay}, '\b{term}\b'))"


def rule_sql(node: str, title, head, body) -> str:
    any_of = lambda terms, hay: " + ".join(word(t, hay) for t in terms) or "0"
    distinct = " + ".join(f"CAST({word(t, 'h')} > 0 AS INT)" for t in body)
    return f"SELECT doc_id, '{node}' AS dc_id, ({any_of(title, 'lower(first)')}) > 0 AS t, ({any_of(head, 'substring(h, 1, 400)')}) > 0 AS hd, ({distinct}) >= 2 AND ({any_of(body, 'h')}) >= 2 AS b FROM base"


CAND_SQL = (
    r"base AS (SELECT doc_id, lower(text) AS h, trim(regexp_extract(text, '(?m)^(.*\S.*)$', 1)) AS first FROM documents), raw AS ("
    + " UNION ALL ".join(rule_sql(*r) for r in X.DEMO_RULES)
    + "), cand AS (SELECT doc_id, dc_id, 1 - (CASE WHEN t THEN 0.3 ELSE 1.0 END::DOUBLE) * (CASE WHEN hd THEN 0.5 ELSE 1.0 END) * (CASE WHEN b THEN 0.6 ELSE 1.0 END) AS confidence FROM raw WHERE t OR hd)"
)


def typed(spark, sf_dir) -> DataFrame:
    return X.candidates(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


@query(f"WITH {CAND_SQL} SELECT doc_id, dc_id, round(confidence, 6) AS confidence FROM cand")
def doctype_noisy_or(spark, sf_dir):
    return typed(spark, sf_dir).select("doc_id", "dc_id", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {CAND_SQL} SELECT doc_id, dc_id, round(max(confidence), 6) AS confidence FROM cand GROUP BY ALL")
def doctype_merge(spark, sf_dir):
    return X.merge(typed(spark, sf_dir), "doc_id").select("doc_id", "dc_id", F.round("confidence", 6).alias("confidence"))


@query(
    f"WITH RECURSIVE {CLOSURE_SQL}, {CAND_SQL} SELECT doc_id, dc_id FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand d JOIN up u ON u.dc_id = d.dc_id AND u.distance > 0 WHERE d.doc_id = c.doc_id AND u.ancestor = c.dc_id)"
)
def ancestor_absorb(spark, sf_dir):
    return X.absorb(X.merge(typed(spark, sf_dir), "doc_id"), X.closure(X.nodes(spark)), "doc_id").select("doc_id", "dc_id")


@query(
    f"WITH {CAND_SQL}, r AS (SELECT doc_id, dc_id, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, dc_id) AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM cand) SELECT doc_id, dc_id, place, greatest(n - 2, 0) AS truncated FROM r WHERE place <= 2"
)
def top_n_labels(spark, sf_dir):
    return X.top_n(X.merge(typed(spark, sf_dir), "doc_id"), "doc_id", 2).select("doc_id", "dc_id", F.col("place").cast("long").alias("place"), "truncated")


@query(
    f"WITH RECURSIVE {CLOSURE_SQL}, cand AS (SELECT conv_id, CASE role WHEN 'user' THEN 'A11' WHEN 'assistant' THEN 'B1' ELSE 'A2' END AS dc_id FROM conversations) "
    "SELECT conv_id, array_to_string(list_sort(list_distinct(list(u.ancestor))), ',') AS roots FROM cand JOIN up u USING (dc_id) WHERE u.ancestor IN ('A', 'B') GROUP BY conv_id HAVING count(DISTINCT u.ancestor) > 1"
)
def cross_branch(spark, sf_dir):
    node = F.when(F.col("role") == "user", "A11").when(F.col("role") == "assistant", "B1").otherwise("A2")
    cands = table(spark, sf_dir, "conversations").select("conv_id", node.alias("dc_id"))
    return X.cross_branch(cands, X.closure(X.nodes(spark)), "conv_id").select("conv_id", F.array_join("roots", ",").alias("roots"))


@query(f"WITH RECURSIVE {CLOSURE_SQL} SELECT dc_id, ancestor, distance FROM up")
def taxonomy_closure(spark, sf_dir):
    return X.closure(X.nodes(spark)).select("dc_id", "ancestor", "distance")


@query(
    f"WITH {CAND_SQL}, e AS (SELECT doc_id, 'B2' AS dc_id, 0.9::DOUBLE AS e FROM documents WHERE doc_id % 7 = 0) SELECT doc_id, dc_id, round(CASE WHEN confidence IS NULL THEN least(e, 0.6) ELSE greatest(confidence, coalesce(e, confidence)) END, 6) AS confidence, CASE WHEN confidence IS NULL THEN 'embed' WHEN e IS NULL THEN 'rule' ELSE 'both' END AS stage FROM cand FULL JOIN e USING (doc_id, dc_id)"
)
def doctype_embed_merge(spark, sf_dir):
    e = table(spark, sf_dir, "documents").filter("doc_id % 7 = 0").select("doc_id", F.lit("B2").alias("dc_id"), F.lit(0.9).alias("confidence"))
    return X.embed_merge(typed(spark, sf_dir), e, "doc_id").withColumn("confidence", F.round("confidence", 6))


# ---------------------------------------------------------------- vectors and seeds

PAIRS_SQL = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT * FROM v WHERE vec_id % 5 = 0), q AS (SELECT * FROM v WHERE vec_id % 5 <> 0),
 near AS (SELECT * FROM (SELECT q.vec_id AS query, s.vec_id AS seed, s.label AS label, list_cosine_similarity(q.e, s.e) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, s.e), 9) DESC, s.vec_id) AS rank FROM q, s) WHERE rank <= 10)"""


def seeded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    return v.filter("vec_id % 5 <> 0"), v.filter("vec_id % 5 = 0")


def seed_grades(seeds: DataFrame) -> DataFrame:
    return seeds.select(F.col("vec_id").alias("seed"), F.element_at(F.array(F.lit("C"), F.lit("S"), F.lit("O")), (F.col("label") % 3 + 1).cast("int")).alias("grade"))


@query(f"WITH {PAIRS_SQL} SELECT query, seed, CAST(rank AS INT) AS rank, round(sim, 6) AS sim FROM near")
def knn_topk(spark, sf_dir):
    q, s = seeded(spark, sf_dir)
    return V.neighbours(q, s, "vec_id", "embedding", 10).withColumn("sim", F.round("sim", 6))


@query(
    f"""WITH {PAIRS_SQL}, n AS (SELECT *, ['C', 'S', 'O'][label % 3 + 1] AS grade FROM near), v2 AS (SELECT query, grade, sum(greatest(sim, 0)) AS w, min(rank) AS r FROM n GROUP BY ALL),
 b AS (SELECT query, sum(w) AS total, arg_max(grade, struct_pack(a := round(w, 9), b := -r)) AS win, max(w) AS w FROM v2 GROUP BY query), t AS (SELECT query, sim, grade FROM n WHERE rank = 1),
 m AS (SELECT b.query, t.sim, t.grade, b.win, b.w / b.total AS share, CASE WHEN t.sim >= 0.4 THEN 'dup_inherit' WHEN t.sim < 0.26 THEN 'too_far' WHEN b.w / b.total < 0.5 THEN 'mixed' ELSE 'knn_vote' END AS method FROM b JOIN t USING (query))
 SELECT query, method, CASE method WHEN 'dup_inherit' THEN grade WHEN 'knn_vote' THEN win END AS grade, round(CASE method WHEN 'dup_inherit' THEN sim WHEN 'knn_vote' THEN share ELSE 0 END, 6) AS confidence FROM m"""
)
def knn_grade_vote(spark, sf_dir):
    q, s = seeded(spark, sf_dir)
    near = V.neighbours(q, s, "vec_id", "embedding", 10)
    return V.grade_vote(near, seed_grades(s), 0.40, 0.26, 0.50).withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH {PAIRS_SQL}, n AS (SELECT query, seed, sim, rank, unnest([label, 10 + label % 2]) AS lab FROM near), t AS (SELECT query, max(sim) AS top, sum(greatest(sim, 0)) AS total, arg_min(seed, rank) AS nearest FROM near GROUP BY query)
 SELECT n.query, lab AS label, round(max(top), 6) AS confidence FROM n JOIN t USING (query) WHERE top >= 0.4 AND seed = nearest GROUP BY n.query, lab
 UNION ALL SELECT n.query, lab, round(sum(greatest(sim, 0)) / max(total), 6) FROM n JOIN t USING (query) WHERE top < 0.4 AND top >= 0.26 GROUP BY n.query, lab HAVING sum(greatest(sim, 0)) / max(total) >= 0.25"""
)
def knn_multilabel(spark, sf_dir):
    q, s = seeded(spark, sf_dir)
    labels = s.select(F.col("vec_id").alias("seed"), F.array(F.col("label"), 10 + F.col("label") % 2).alias("labels"))
    return V.label_vote(V.neighbours(q, s, "vec_id", "embedding", 10), labels, 0.40, 0.26, 0.25).withColumn("confidence", F.round("confidence", 6))


NEAR_SQL = "SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, list_cosine_similarity(a.e, b.e) AS sim FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a JOIN (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.4"


@query(f"SELECT a, b, round(sim, 6) AS sim FROM ({NEAR_SQL})")
def near_dup_pairs(spark, sf_dir):
    return V.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.4).withColumn("sim", F.round("sim", 6))


@query(f"SELECT a, b, ['C', 'S', 'O'][la % 3 + 1] AS grade_a, ['C', 'S', 'O'][lb % 3 + 1] AS grade_b FROM ({NEAR_SQL}) WHERE la % 3 <> lb % 3")
def conflict_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return V.conflicts(V.near_duplicates(v, "vec_id", "embedding", 0.4), seed_grades(v)).select("a", "b", "grade_a", "grade_b")


@query(
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT * FROM v WHERE vec_id % 5 = 0) SELECT v.vec_id AS query, round(max(list_cosine_similarity(v.e, s.e)), 6) AS sim FROM v JOIN s ON v.vec_id <> s.vec_id GROUP BY v.vec_id"
)
def nearest_excl_self(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    near = V.neighbours(v, v.filter("vec_id % 5 = 0"), "vec_id", "embedding", 1, other_only=True)
    return near.select("query", F.round("sim", 6).alias("sim"))


@query("SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY ALL")
def seed_dimensions(spark, sf_dir):
    return V.dimensions(table(spark, sf_dir, "embeddings"), "embedding").select(F.col("dim").cast("long").alias("dim"), "n")


@query(
    "SELECT doc_id, CAST(unnest(range(0, CASE WHEN n_chars <= 512 THEN 0 ELSE CAST(ceil((n_chars - 512) / 448.0) AS BIGINT) END + 1)) * 448 AS BIGINT) AS start FROM documents"
)
def chunk_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(V.chunk_windows(F.col("n_chars"), 512, 64)).alias("w")).select("doc_id", F.col("w.start").cast("long").alias("start"))


@query("SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM embeddings) WHERE r <= 5")
def seed_caps_single(spark, sf_dir):
    return S.capped(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 5, F.col("vec_id").desc())


@query()
def seed_caps_joint(spark, sf_dir):
    seeds = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", "vec_id % 13 AS folder")
    return S.capped_jointly(seeds, {"label": 5, "folder": 3}, "vec_id")


@query("SELECT ['C', 'S', 'O'][label % 3 + 1] AS grade, count(*) AS n, count(*) < max(count(*)) OVER () / 4 AS weak FROM embeddings GROUP BY 1")
def seed_balance(spark, sf_dir):
    return S.balance(seed_grades(table(spark, sf_dir, "embeddings")))


SEED_SQL = "seeds AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE md5(text) END AS hash, CASE WHEN doc_id % 3 = 0 THEN 'suspect' ELSE 'active' END AS state FROM documents WHERE doc_id % 4 = 0), recs AS (SELECT doc_id, md5(text) AS hash FROM documents WHERE doc_id % 10 <> 0)"


def seeds_and_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("hash", F.md5(F.col("text").cast("binary")))
    seeds = d.filter("doc_id % 4 = 0").selectExpr("doc_id", "CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE hash END AS hash", "CASE WHEN doc_id % 3 = 0 THEN 'suspect' ELSE 'active' END AS state")
    return seeds, d.filter("doc_id % 10 <> 0").select("doc_id", "hash")


@query(
    f"WITH {SEED_SQL}, j AS (SELECT s.doc_id, s.state, CASE WHEN r.hash IS NULL THEN 'missing' WHEN r.hash <> s.hash THEN 'stale' END AS why FROM seeds s LEFT JOIN recs r USING (doc_id)) "
    "SELECT doc_id, state AS before, CASE WHEN state = 'active' THEN 'suspect' ELSE 'active' END AS after, coalesce(why, 'recovered') AS reason FROM j WHERE (state = 'active') = (why IS NOT NULL)"
)
def seed_sync_events(spark, sf_dir):
    return S.sync(*seeds_and_records(spark, sf_dir), "doc_id")


@query(
    f"""WITH {SEED_SQL}, v AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN CASE WHEN doc_id % 24 = 0 THEN 3 ELSE 2 END END AS dim FROM documents),
 j AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN dim IS NULL THEN 'no_vector' END, CASE WHEN dim <> 2 THEN 'odd_dimension' END, CASE WHEN r.hash IS NULL THEN 'missing' WHEN r.hash <> s.hash THEN 'stale' END, CASE WHEN state = 'suspect' THEN 'suspect' END, CASE WHEN doc_id % 5 = 0 THEN 'odd_engine' END,
  CASE WHEN doc_id % 28 = 0 THEN 'orphan_type' END, CASE WHEN doc_id % 44 IN (0, 4) THEN 'conflict' END], lambda x: x IS NOT NULL), ',') AS problems FROM seeds s JOIN v USING (doc_id) LEFT JOIN recs r USING (doc_id)) SELECT doc_id, problems FROM j WHERE problems <> ''"""
)
def seed_health(spark, sf_dir):
    seeds, records = seeds_and_records(spark, sf_dir)
    two = F.when(F.col("doc_id") % 24 == 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    seeds = seeds.withColumns(
        {
            "vector": F.when(F.col("doc_id") % 9 != 0, two),
            "engine": F.when(F.col("doc_id") % 5 == 0, "old").otherwise("new"),
            "doctype": F.array(F.when(F.col("doc_id") % 28 == 0, "Z").otherwise("A1")),
        }
    )
    pairs = seeds.filter("doc_id % 44 = 0").selectExpr("doc_id AS a", "doc_id + 4 AS b")
    return S.health(seeds, records, "doc_id", X.nodes(spark), pairs).select("doc_id", F.array_join("problems", ",").alias("problems"))


@query(f"WITH {SEED_SQL} SELECT doc_id, coalesce(r.hash, s.hash) AS hash, s.state FROM seeds s FULL JOIN recs r USING (doc_id)")
def seed_upsert(spark, sf_dir):
    return S.upsert(*seeds_and_records(spark, sf_dir), "doc_id")


# ---------------------------------------------------------------- review, roll-ups, evaluation


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_override(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "value")


RESOLVE_SQL = "o AS (SELECT event_id AS line, CASE WHEN event_id % 2 = 0 THEN user_id END AS id1, CASE WHEN event_id % 2 = 1 THEN user_id END AS id2, event_type FROM events)"


@query(
    f"WITH {RESOLVE_SQL}, a AS (SELECT id1 AS id, arg_max(event_type, line) AS v FROM o WHERE id1 IS NOT NULL GROUP BY 1), b AS (SELECT id2 AS id, arg_max(event_type, line) AS v FROM o WHERE id2 IS NOT NULL GROUP BY 1) "
    "SELECT doc_id, coalesce(a.v, b.v) AS event_type, CASE WHEN a.v IS NOT NULL THEN 'id1' WHEN b.v IS NOT NULL THEN 'id2' END AS rematched_by FROM documents d LEFT JOIN a ON d.doc_id = a.id LEFT JOIN b ON d.doc_id + 1 = b.id"
)
def override_resolution(spark, sf_dir):
    o = table(spark, sf_dir, "events").selectExpr("event_id AS line", "CASE WHEN event_id % 2 = 0 THEN user_id END AS id1", "CASE WHEN event_id % 2 = 1 THEN user_id END AS id2", "event_type")
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id AS id1", "doc_id + 1 AS id2")
    return R.resolved(d, o, ["id1", "id2"], "event_type").select("doc_id", "event_type", "rematched_by")



@query(
    "WITH m AS (SELECT conv_id, CASE turn % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'S' WHEN 3 THEN 'C' END AS grade FROM conversations) SELECT conv_id, CASE max(CASE grade WHEN 'C' THEN 3 WHEN 'S' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) WHEN 3 THEN 'C' WHEN 2 THEN 'S' WHEN 1 THEN 'O' END AS grade, count(*) FILTER (grade = 'C') AS n_c, count(*) FILTER (grade = 'S') AS n_s, count(*) FILTER (grade = 'O') AS n_o, count(*) FILTER (grade IS NULL) AS n_none FROM m GROUP BY conv_id"
)
def rollup_origin(spark, sf_dir):
    grade = F.expr("CASE turn % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'S' WHEN 3 THEN 'C' END")
    return R.rolled_up(table(spark, sf_dir, "conversations").withColumn("grade", grade), "conv_id")


@query(GRADED_SQL + "SELECT coalesce(source, 'all') AS source, coalesce(grade, 'all') AS grade, count(*) AS docs FROM (SELECT source, coalesce(grade, 'none') AS grade FROM g) GROUP BY ROLLUP (source, grade)")
def summary_rollup(spark, sf_dir):
    g = graded(spark, sf_dir).select("source", F.coalesce("security.grade", F.lit("none")).alias("grade"))
    out = g.rollup("source", "grade").agg(F.count("*").alias("docs"))
    return out.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("grade", F.lit("all")).alias("grade"), "docs")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id || '-7'), doc_id) AS r FROM documents) WHERE r <= 5")
def stratified_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return S.capped(d, "source", 5, F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("-7")), 256), "doc_id")


PR_SQL = f"SELECT l.toxic AS truth, CASE WHEN {n_of('idiot')} + {n_of('stupid')} + {n_of('moron')} > 0 THEN 1 ELSE 0 END AS p, 1.0 / count(*) OVER (PARTITION BY source) AS w FROM labels l JOIN documents USING (doc_id)"


@query(
    f"WITH r AS ({PR_SQL}), s AS (SELECT sum(CASE WHEN truth = 1 AND p = 1 THEN w ELSE 0 END) AS tp, sum(CASE WHEN truth <> 1 AND p = 1 THEN w ELSE 0 END) AS fp, sum(CASE WHEN truth = 1 AND p <> 1 THEN w ELSE 0 END) AS fn FROM r) SELECT round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM s"
)
def weighted_precision_recall(spark, sf_dir):
    hay = F.lower("text")
    n = T.count_literal(hay, "idiot") + T.count_literal(hay, "stupid") + T.count_literal(hay, "moron")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("toxic", (n > 0).cast("int").alias("p"), "source")
    rows = rows.withColumn("w", 1.0 / F.count("*").over(W.partitionBy("source")))
    out = R.precision_recall(rows, "toxic", "p", F.col("w"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("tp", "fp", "fn", "precision", "recall")])


@query(
    "WITH b AS (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0), a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels WHERE doc_id % 4 <> 0) "
    "SELECT doc_id, b.quality AS before, a.quality AS after, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'gone' ELSE 'changed' END AS change FROM b FULL JOIN a USING (doc_id) WHERE b.quality IS DISTINCT FROM a.quality"
)
def run_diff(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    after = labels.filter("doc_id % 4 <> 0").selectExpr("doc_id", "CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    return R.diff(labels.filter("doc_id % 3 <> 0"), after, "doc_id", "quality")


# ---------------------------------------------------------------- mining

WORDS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z\\x{00e0}-\\x{024f}0-9]+'), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '[0-9]')))"
MINE_SQL = f"""d AS (SELECT doc_id, source, toxic = 1 AS pos, 1.0::DOUBLE / count(*) OVER (PARTITION BY source, toxic = 1) AS w, text FROM documents JOIN labels USING (doc_id)),
 t AS (SELECT sum(CASE WHEN pos THEN w ELSE 0 END) AS n_pos, sum(CASE WHEN NOT pos THEN w ELSE 0 END) AS n_neg FROM d), l AS (SELECT pos, w, source, unnest({WORDS_SQL}) AS term FROM d),
 p AS (SELECT term, sum(w) AS w_pos, count(*) AS docs, count(DISTINCT source) AS folders FROM l WHERE pos GROUP BY term), n AS (SELECT term, sum(w) AS w_neg FROM l WHERE NOT pos GROUP BY term),
 f AS (SELECT term, w_pos / greatest(n_pos, 1e-12) AS df_pos, coalesce(w_neg, 0) / greatest(n_neg, 1e-12) AS df_neg, docs, folders, n_pos, n_neg FROM p LEFT JOIN n USING (term), t)"""


def mined(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("source", "text", "toxic")
    return M.weighted_frequencies(d, F.col("toxic") == 1, "source")


@query("SELECT source, toxic, round(1.0::DOUBLE / count(*), 9) AS w FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def cluster_weight(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return M.cluster_weights(d, "source", "toxic").withColumn("w", F.round("w", 9))


@query(f"WITH {MINE_SQL} SELECT term, docs, folders, round(df_pos, 6) AS df_pos, round(df_neg, 6) AS df_neg, round(ln((df_pos + 0.5 / greatest(n_pos, 1)) / (df_neg + 0.5 / greatest(n_neg, 1))), 6) AS log_odds FROM f")
def term_log_odds(spark, sf_dir):
    return mined(spark, sf_dir).select("term", "docs", "folders", *[F.round(c, 6).alias(c) for c in ("df_pos", "df_neg", "log_odds")])


@query(f"WITH {MINE_SQL} SELECT CASE WHEN docs < 3 THEN 'few_docs' WHEN folders < 2 THEN 'few_folders' WHEN round(df_neg, 9) > 0.05 THEN 'too_common' ELSE 'ok' END AS verdict, count(*) AS terms FROM f GROUP BY ALL")
def term_candidates(spark, sf_dir):
    return mined(spark, sf_dir).groupBy(M.verdict().alias("verdict")).agg(F.count("*").alias("terms"))



# ---------------------------------------------------------------- sources and identity



@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return d.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def event_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "SELECT n, strftime(DATE '1899-12-30' + CAST(CASE WHEN n < 60 THEN n + 1 ELSE n END AS INT), '%Y-%m-%d') AS day FROM range(1, 60000, 37) t(n)"
)
def excel_serial(spark, sf_dir):
    return spark.range(1, 60000, 37).select(F.col("id").alias("n"), extract.excel_day(F.col("id")).alias("day"))
