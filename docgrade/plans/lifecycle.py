"""Queries of what happens around grading: propagation, seeds, review, mining, evaluation, intake.

They are added to the registry beside the others; a query's SQL says the same in its own way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sinks
from ..functions import pii
from ..operators import evaluate as E
from ..operators import grading as G
from ..operators import mining as M
from ..operators import propagate as P
from ..operators import review as R
from ..operators import seeds as S
from ..operators import taxonomy as X
from ..operators import vocabulary as V
from ..sources import extract, files, manifests
from ..streaming import grade as live
from . import rules
from .policy import DEMO, KeywordRule, Policy, RegexRule
from .registry import CAND_SQL, CLOSURE_SQL, COUNTS_SQL, GRADED_SQL, MINE_SQL, WORDS_SQL, documents, graded, mined, n_of, query, seed_grades, table, typed

# ---------------------------------------------------------------- rules by their own operators

CAPPED = Policy(regex=(RegexRule("R1", "EMAIL", "S", "C", 3), RegexRule("R2", "CARD", "C"), RegexRule("R3", "IP", "O")), pii_grade_cap="S")


@query(
    f"""WITH c AS ({COUNTS_SQL}), h AS (SELECT doc_id, unnest([CASE WHEN n_email > 0 THEN {{'id': 'R1', 'n': n_email, 'grade': 'S', 'was': CASE WHEN n_email >= 3 THEN 'C' END}} END,
 CASE WHEN n_card > 0 THEN {{'id': 'R2', 'n': n_card, 'grade': 'S', 'was': 'C'}} END, CASE WHEN n_ip > 0 THEN {{'id': 'R3', 'n': n_ip, 'grade': 'O', 'was': NULL}} END]) AS h FROM c)
 SELECT doc_id, h.id AS id, h.n AS n, h.grade AS grade, h.was AS capped_from FROM h WHERE h IS NOT NULL"""
)
def pii_cap(spark, sf_dir):
    docs = G.with_counts(table(spark, sf_dir, "documents"), CAPPED)
    return docs.select("doc_id", F.inline(G.pii_hits(CAPPED))).select("doc_id", "id", F.col("count").cast("long").alias("n"), "grade", "capped_from")


@query(
    f"""WITH c AS ({COUNTS_SQL}) SELECT doc_id, 'M1' AS id, 2 AS n FROM c WHERE n_email > 0 AND n_ip > 0
 UNION ALL SELECT doc_id, 'M2', CAST(n_email > 0 AS INT) + CAST(n_ip > 0 AS INT) + CAST(n_card > 0 AS INT) FROM c WHERE CAST(n_email > 0 AS INT) + CAST(n_ip > 0 AS INT) + CAST(n_card > 0 AS INT) >= 2"""
)
def pii_combo_division(spark, sf_dir):
    docs = G.with_counts(table(spark, sf_dir, "documents"), DEMO)
    return docs.select("doc_id", F.inline(G.pii_hits(DEMO))).filter("layer = 'COMBO'").select("doc_id", "id", F.col("count").alias("n"))


@query("SELECT page_id, CASE WHEN contains(lower(list_last(str_split(url, '/'))), '1') THEN 'N1' END AS id FROM pages")
def filename_signal(spark, sf_dir):
    policy = Policy(keywords=(KeywordRule("N1", (), "O", ("1",)),))
    return table(spark, sf_dir, "pages").select("page_id", F.get(G.name_hits(policy, F.col("url")), 0)["id"].alias("id"))


CONFIDENCE_SQL = (
    GRADED_SQL.replace("list_max([", "[").replace("]) AS rule,", "] AS rules,").replace("greatest(rule, sensitive, stamp) AS top", "greatest(list_max(rules), sensitive, stamp) AS top").split(" g AS (")[0].rstrip(", \n")
    + """, x AS (SELECT *, list_filter(list_zip(rules || [sensitive] || [n_t1], [0.9, 0.6, 0.95, 0.95, 0.95, 0.7, 0.8, 0.7, 0.0], [1, 0, 1, 1, 1, 1, 1, 0, 0]), lambda h: h[1] = top) AS hit FROM (SELECT f.*, 0 AS n_t1 FROM f))

 , y AS (SELECT doc_id, CASE WHEN top = 0 THEN 0.0 ELSE greatest(coalesce(list_max(list_transform(hit, lambda h: h[2]))::DOUBLE, 0), CASE WHEN stamp = top THEN 0.85 ELSE 0 END) END AS confidence,
 top > 0 AND coalesce(list_max(list_transform(hit, lambda h: h[3])), 0) = 1 AS seed_eligible FROM x) """
)


@query(CONFIDENCE_SQL + "SELECT * FROM y")
def security_confidence(spark, sf_dir):
    return graded(spark, sf_dir).select("doc_id", "security.confidence", "security.seed_eligible")


@query(
    GRADED_SQL
    + "SELECT doc_id, grade, decided_by, array_to_string(list_filter([CASE WHEN contains(decided_by, 'sensitive') THEN 'sensitive: E1×' || n_e1 END], lambda x: x IS NOT NULL), '; ') AS sensitive_why FROM g JOIN k USING (doc_id)"
)
def why_summary(spark, sf_dir):
    r = G.record(graded(spark, sf_dir), "doc_id", F.lit("2026-01-01 00:00:00"))
    only = F.array_join(F.filter(F.split(sinks.why(), "; "), lambda x: x.startswith("sensitive")), "; ")
    return sinks.simple(r, with_why=True).join(r.select("doc_id", only.alias("sensitive_why")), "doc_id").select("doc_id", "grade", "decided_by", "sensitive_why")


@query(
    CONFIDENCE_SQL
    + """, d AS (SELECT doc_id, CASE top WHEN 3 THEN 'C' WHEN 2 THEN 'S' WHEN 1 THEN 'O' END AS grade, array_to_string(list_filter([CASE WHEN top > 0 AND list_max(rules) = top THEN 'rule' END, CASE WHEN top > 0 AND sensitive = top THEN 'sensitive' END, CASE WHEN top > 0 AND stamp = top THEN 'stamp' END], lambda x: x IS NOT NULL), ',') AS decided_by FROM f)
 SELECT doc_id, grade, confidence, decided_by FROM d JOIN y USING (doc_id)"""
)
def simple_records(spark, sf_dir):
    return G.simple(G.record(graded(spark, sf_dir), "doc_id", F.lit("2026-01-01 00:00:00")), "doc_id")


PAGE_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[ >].*?</script\s*>|<style[ >].*?</style\s*>|<head[ >].*?</head\s*>|<noscript[ >].*?</noscript\s*>|<!--.*?-->', '', 'g'), '(?i)</?(?:p|div|br|tr|td|th|li|table|h1|h2|h3|h4|h5|h6|ul|ol|section|article|header|footer|hr)(?:[\s/][^>]*)?>', chr(10), 'g') AS t FROM pages),
 b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[/!a-zA-Z][^>]*>', '', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM a)
 SELECT page_id, array_to_string(list_filter(list_transform(str_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b"""


@query(PAGE_SQL)
def html_text(spark, sf_dir):
    return extract.html(table(spark, sf_dir, "pages"), "page_id", "html")


# ---------------------------------------------------------------- propagation

OPEN_SQL = f"""{GRADED_SQL.rstrip()}, v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT * FROM v WHERE vec_id % 5 = 0), q AS (SELECT v.* FROM v JOIN g ON g.doc_id = v.vec_id WHERE g.grade IS NULL),
 near AS (SELECT * FROM (SELECT q.vec_id AS query, s.vec_id AS seed, ['C', 'S', 'O'][s.label % 3 + 1] AS grade, list_cosine_similarity(q.e, s.e) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, s.e), 9) DESC, s.vec_id) AS rank FROM q JOIN s ON q.vec_id <> s.vec_id) WHERE rank <= 10),
 v2 AS (SELECT query, grade, sum(greatest(sim, 0)) AS w, min(rank) AS r FROM near GROUP BY ALL), b AS (SELECT query, sum(w) AS total, arg_max(grade, struct_pack(a := round(w, 9), b := -r)) AS win, max(w) AS w FROM v2 GROUP BY query),
 t AS (SELECT query, sim, grade FROM near WHERE rank = 1), m AS (SELECT b.query, t.sim, t.grade AS dup_grade, b.win, b.w / b.total AS share, CASE WHEN t.sim >= 0.4 THEN 'dup_inherit' WHEN t.sim < 0.26 THEN 'too_far' WHEN b.w / b.total < 0.5 THEN 'mixed' ELSE 'knn_vote' END AS method FROM b JOIN t USING (query)),
 p AS (SELECT g.doc_id, coalesce(g.grade, CASE m.method WHEN 'dup_inherit' THEN dup_grade WHEN 'knn_vote' THEN win END) AS grade, CASE WHEN g.grade IS NOT NULL THEN 'graded' WHEN v.vec_id IS NULL THEN 'no_vector' ELSE coalesce(m.method, 'no_seed') END AS outcome,
  CASE WHEN g.grade IS NOT NULL THEN g.decided_by WHEN m.method IN ('dup_inherit', 'knn_vote') THEN 'embed' ELSE '' END AS decided_by, round(CASE m.method WHEN 'dup_inherit' THEN sim WHEN 'knn_vote' THEN share ELSE 0 END, 6) AS embed_confidence FROM g LEFT JOIN v ON v.vec_id = g.doc_id LEFT JOIN m ON m.query = g.doc_id) """


def propagated(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    signals = [f"signal_{n}" for n in P.STORED]
    records = graded(spark, sf_dir).select("doc_id", "security", *signals).join(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")
    approved = v.filter("vec_id % 5 = 0")
    seeds = approved.select(F.col("vec_id").alias("seed"), F.col("embedding").alias("vector")).join(seed_grades(approved), "seed")
    return P.security(records, P.seed_index(seeds.withColumn("seed_eligible", F.lit(True)).limit(0), seeds), "doc_id", k=10, dup=0.40, min_sim=0.26, min_share=0.50)


@query(OPEN_SQL + "SELECT doc_id, grade, outcome, decided_by, CASE WHEN outcome = 'graded' THEN 0.0 ELSE coalesce(embed_confidence, 0.0) END AS embed_confidence FROM p")
def propagate_security(spark, sf_dir):
    embed = F.when(F.col("outcome") == "graded", 0.0).otherwise(F.round("security.confidence", 6))
    return propagated(spark, sf_dir).select("doc_id", "security.grade", "outcome", F.array_join("security.decided_by", ",").alias("decided_by"), embed.alias("embed_confidence"))


@query(OPEN_SQL + "SELECT outcome, count(*) AS records, count(*) FILTER (grade IS NOT NULL) AS graded FROM p GROUP BY outcome")
def propagate_outcomes(spark, sf_dir):
    return P.outcomes(propagated(spark, sf_dir))


DT_SQL = f"""WITH {CAND_SQL}, v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT * FROM v WHERE vec_id % 5 = 0),
 near AS (SELECT * FROM (SELECT q.vec_id AS query, s.vec_id AS seed, s.label AS label, list_cosine_similarity(q.e, s.e) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, s.e), 9) DESC, s.vec_id) AS rank FROM v q JOIN s ON q.vec_id <> s.vec_id) WHERE rank <= 10),
 lab AS (SELECT query, seed, sim, rank, unnest([['A1', 'B1', 'B2', 'A2'][label % 4 + 1], ['A11', 'ZZ'][label % 2 + 1]]) AS dc_id FROM near), top AS (SELECT query, max(sim) AS top, sum(greatest(sim, 0)) AS total, arg_min(seed, rank) AS nearest FROM near GROUP BY query),
 e AS (SELECT l.query AS doc_id, dc_id, max(top) AS e FROM lab l JOIN top USING (query) WHERE top >= 0.4 AND seed = nearest GROUP BY ALL UNION ALL SELECT l.query, dc_id, sum(greatest(sim, 0)) / max(total) FROM lab l JOIN top USING (query) WHERE top < 0.4 AND top >= 0.26 GROUP BY ALL HAVING sum(greatest(sim, 0)) / max(total) >= 0.25)
 SELECT doc_id, dc_id, round(CASE WHEN confidence IS NULL THEN least(e, 0.6) ELSE greatest(confidence, coalesce(e, confidence)) END, 6) AS confidence, CASE WHEN confidence IS NULL THEN 'embed' WHEN e IS NULL THEN 'rule' ELSE 'both' END AS stage FROM cand FULL JOIN (SELECT * FROM e WHERE dc_id <> 'ZZ') e USING (doc_id, dc_id)"""


@query(DT_SQL)
def propagate_doctype(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    names = F.array(F.get(F.array(*map(F.lit, ("A1", "B1", "B2", "A2"))), (F.col("label") % 4).cast("int")), F.get(F.array(F.lit("A11"), F.lit("ZZ")), (F.col("label") % 2).cast("int")))
    seeds = v.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("seed"), names.alias("labels"), F.col("embedding").alias("vector"))
    docs = v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    out = P.doctype(typed(spark, sf_dir), docs, seeds, X.nodes(spark), "doc_id", k=10, dup=0.40, min_sim=0.26, min_share=0.25)
    return out.withColumn("confidence", F.round("confidence", 6))


@query(GRADED_SQL.rstrip() + f", {CAND_SQL} SELECT doc_id FROM g WHERE grade IS NULL OR doc_id NOT IN (SELECT doc_id FROM cand)")
def embed_needed(spark, sf_dir):
    typed_ = typed(spark, sf_dir).select("doc_id").distinct().withColumn("has", F.lit(True))
    g = graded(spark, sf_dir).join(typed_, "doc_id", "left")
    return g.filter(P.needs_vector(F.col("security.grade"), F.lit(False), F.col("has"))).select("doc_id")


# ---------------------------------------------------------------- document types


@query("SELECT page_id, 'B2' AS dc_id, 0.5::DOUBLE AS confidence FROM pages WHERE regexp_matches(lower(list_last(str_split(url, '/'))), '\\b2\\b')")
def doctype_name_signal(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("").alias("text"))
    return X.candidates(pages, [("B2", (), (), (), ("2",))], file="url").select("page_id", "dc_id", "confidence")


@query(
    "SELECT page_id, CASE WHEN contains(html, 'license') THEN 'A1' ELSE 'B1' END AS dc_id, NOT contains(html, 'license') AS review FROM pages WHERE contains(html, 'license') OR regexp_matches(url, '[a-z]$')"
)
def doctype_or_name(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    fired = pages.filter(F.contains("html", F.lit("license"))).select("page_id", F.lit("A1").alias("dc_id"), F.lit(0.7).alias("confidence"), F.array(F.lit("head")).alias("sources"))
    ends = pages.filter(F.col("url").rlike("[a-z]$")).select("page_id", F.lit("B1").alias("dc_id"), F.lit(0.3).alias("confidence"))
    return X.or_by_name(fired, ends, "page_id").select("page_id", "dc_id", "review")


@query(f"WITH t AS (SELECT DISTINCT dc_id, parent FROM (SELECT 'S' || (s_suppkey % 7) AS dc_id, CAST(NULL AS VARCHAR) AS parent FROM supplier UNION SELECT 'P' || p_partkey, 'S' || (p_partkey % 5) FROM part)) SELECT dc_id, parent IS NULL AND dc_id IN (SELECT parent FROM t WHERE parent IS NOT NULL) AS drawer FROM t")
def taxonomy_drawers(spark, sf_dir):
    roots = table(spark, sf_dir, "supplier").selectExpr("concat('S', s_suppkey % 7) AS dc_id", "CAST(NULL AS STRING) AS parent")
    tree = roots.unionByName(table(spark, sf_dir, "part").selectExpr("concat('P', p_partkey) AS dc_id", "concat('S', p_partkey % 5) AS parent")).distinct()
    return X.drawers(tree).select("dc_id", F.lit(True).alias("drawer")).unionByName(X.ruled(tree).select("dc_id", F.lit(False).alias("drawer")))


@query("WITH p AS (SELECT DISTINCT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT r_name AS dc_id, CAST(NULL AS VARCHAR) AS parent, 0 AS ord FROM p UNION SELECT n_name, r_name, 1 FROM p")
def taxonomy_from_paths(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    paths = n.join(r, n.n_regionkey == r.r_regionkey).select(F.array("r_name", "n_name").alias("path_ids"), F.concat_ws(" > ", "r_name", "n_name").alias("path"))
    return X.from_paths(paths).select("dc_id", "parent", "ord")


@query("SELECT n_name AS dc_id, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, NULL FROM region")
def taxonomy_from_export(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nodes = n.join(r, n.n_regionkey == r.r_regionkey).selectExpr("n_name AS dc_id", "r_name AS parent_dc_id", "n_nationkey AS order_num", "n_name AS title")
    nodes = nodes.unionByName(r.selectExpr("r_name AS dc_id", "'' AS parent_dc_id", "r_regionkey AS order_num", "r_name AS title"))
    return X.from_export(nodes).select("dc_id", "parent")


@query(
    f"WITH RECURSIVE {CLOSURE_SQL}, {CAND_SQL} SELECT u.ancestor AS root, count(DISTINCT doc_id) AS docs FROM cand JOIN up u USING (dc_id) WHERE u.ancestor IN ('A', 'B') GROUP BY 1"
)
def roots_rollup(spark, sf_dir):
    return R.by_root(typed(spark, sf_dir), X.closure(X.nodes(spark)))


@query(
    """WITH b AS (SELECT source AS dc_id, list_distinct(list(lang)) AS terms FROM documents WHERE source IS NOT NULL AND doc_id % 3 = 0 GROUP BY 1), a AS (SELECT source AS dc_id, list_distinct(list(lang)) AS terms FROM documents WHERE source IS NOT NULL AND doc_id % 7 = 0 GROUP BY 1),
 j AS (SELECT dc_id, b.dc_id IS NULL AS no_b, a.dc_id IS NULL AS no_a, list_sort(list_filter(coalesce(a.terms, []), lambda x: NOT list_contains(coalesce(b.terms, []), x))) AS added, list_sort(list_filter(coalesce(b.terms, []), lambda x: NOT list_contains(coalesce(a.terms, []), x))) AS removed FROM b FULL JOIN a USING (dc_id))
 SELECT dc_id, CASE WHEN no_b THEN 'new' WHEN no_a THEN 'removed' ELSE 'changed' END AS change, array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed FROM j WHERE no_a OR no_b OR len(added) + len(removed) > 0"""
)
def rule_changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    of = lambda n: d.filter(F.col("doc_id") % n == 0).groupBy(F.col("source").alias("dc_id")).agg(F.collect_set("lang").alias("terms"))
    return rules.changes(of(3), of(7)).withColumns({c: F.array_join(c, ",") for c in ("added", "removed")})


# ---------------------------------------------------------------- review

LABELS_SQL = """l AS (SELECT doc_id, CASE WHEN quality = 1 THEN ['A1', 'B1'] ELSE ['B1'] END AS auto, CASE WHEN doc_id % 3 = 0 THEN ['A2'] ELSE [] END AS proposed, CASE WHEN doc_id % 4 = 0 THEN ['B1', 'B2'] ELSE [] END AS confirmed, CASE WHEN doc_id % 5 = 0 THEN ['A1', 'A2'] ELSE [] END AS rejected FROM labels),
 x AS (SELECT *, list_sort(list_distinct(auto || proposed || confirmed || rejected)) AS every FROM l),
 e AS (SELECT doc_id, list_transform(every, lambda x: x || '=' || CASE WHEN list_contains(rejected, x) THEN 'rejected' WHEN list_contains(confirmed, x) THEN CASE WHEN list_contains(auto || proposed, x) THEN 'confirmed' ELSE 'manual' END WHEN list_contains(proposed, x) THEN 'proposed' ELSE 'auto' END) AS labels FROM x)"""


def reviewed(spark, sf_dir) -> DataFrame:
    some = lambda cond, *v: F.when(F.expr(cond), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>"))
    auto = F.when(F.col("quality") == 1, F.array(F.lit("A1"), F.lit("B1"))).otherwise(F.array(F.lit("B1")))
    labels = R.effective_doctype(auto, some("doc_id % 3 = 0", "A2"), some("doc_id % 4 = 0", "B1", "B2"), some("doc_id % 5 = 0", "A1", "A2"))
    return table(spark, sf_dir, "labels").select("doc_id", labels.alias("labels"))


@query(
    f"WITH {LABELS_SQL} SELECT doc_id, array_to_string(labels, ',') AS labels, CASE WHEN len(list_filter(labels, lambda x: contains(x, 'confirmed') OR contains(x, 'manual'))) > 0 THEN CASE WHEN len(list_filter(labels, lambda x: contains(x, 'proposed') OR contains(x, 'auto'))) = 0 THEN 'confirmed' ELSE 'mixed' END "
    "WHEN len(list_filter(labels, lambda x: contains(x, 'proposed') OR contains(x, 'auto'))) > 0 THEN 'open' ELSE 'rejected' END AS status FROM e"
)
def effective_doctype(spark, sf_dir):
    r = reviewed(spark, sf_dir)
    return r.select("doc_id", F.array_join(F.transform("labels", lambda x: F.concat(x["dc_id"], F.lit("="), x["status"])), ",").alias("labels"), R.doctype_status(F.col("labels")).alias("status"))


FRAME_SQL = (
    GRADED_SQL.rstrip()
    + f""", {LABELS_SQL}, o AS (SELECT user_id, arg_max(CASE event_type WHEN 'purchase' THEN 'C' WHEN 'click' THEN 'S' ELSE 'O' END, event_id) AS new_grade FROM events GROUP BY 1),
 fr AS (SELECT g.doc_id, coalesce(o.new_grade, g.grade) AS effective, o.new_grade IS NOT NULL AND o.new_grade IS DISTINCT FROM g.grade AS changed, coalesce(e.labels, []) AS labels FROM g LEFT JOIN o ON o.user_id = g.doc_id LEFT JOIN e ON e.doc_id = g.doc_id),
 n AS (SELECT doc_id, effective, changed, effective IS NULL AND doc_id % 6 <> 0 AS need_sec, len(list_filter(labels, lambda x: contains(x, '=proposed') OR contains(x, '=auto'))) > 0 AND doc_id % 6 <> 0 AS need_doc FROM fr) """
)


def frame(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    new = F.when(kind == "purchase", "C").when(kind == "click", "S").otherwise("O")
    log = R.latest(table(spark, sf_dir, "events").withColumn("new_grade", new), "user_id", "event_id", "new_grade").withColumnRenamed("user_id", "doc_id")
    records = graded(spark, sf_dir).select("doc_id", "security.grade", "security.confidence", F.lit(False).alias("held")).join(log, "doc_id", "left").join(reviewed(spark, sf_dir), "doc_id", "left")
    records = records.withColumn("labels", F.coalesce("labels", F.array().cast("array<struct<dc_id:string,status:string>>")))
    seeds = table(spark, sf_dir, "documents").filter("doc_id % 6 = 0")
    return R.review_frame(R.effective_grade(records), seeds=seeds)


@query(FRAME_SQL + "SELECT doc_id, effective, changed, need_sec, need_doc FROM n")
def review_frame(spark, sf_dir):
    return frame(spark, sf_dir).select("doc_id", "effective", "changed", "need_sec", "need_doc")


@query(FRAME_SQL + "SELECT doc_id, need_sec, need_doc FROM n JOIN (SELECT doc_id, grade IS NULL AS no_grade FROM g) USING (doc_id) WHERE need_sec ORDER BY need_doc DESC, doc_id LIMIT 30")
def review_queue(spark, sf_dir):
    f = frame(spark, sf_dir).filter("need_sec")
    return R.inbox(f).select("doc_id", "need_sec", "need_doc")


@query(FRAME_SQL + "SELECT count(*) AS docs, count(*) FILTER (effective = 'C') AS n_c, count(*) FILTER (effective = 'S') AS n_s, count(*) FILTER (effective = 'O') AS n_o, count(*) FILTER (effective IS NULL) AS n_none, count(*) FILTER (changed) AS n_changed, count(*) FILTER (need_sec) AS n_need_sec, count(*) FILTER (need_doc) AS n_need_doc FROM n")
def dashboard(spark, sf_dir):
    return R.dashboard(frame(spark, sf_dir))


@query(FRAME_SQL + "SELECT doc_id, effective AS grade, array_to_string(list_transform(list_filter(coalesce(e.labels, []), lambda x: NOT contains(x, '=rejected')), lambda x: str_split(x, '=')[1]), ',') AS labels, changed FROM n LEFT JOIN e USING (doc_id) WHERE effective IN ('C', 'S') AND (need_sec OR need_doc)")
def filtered_export(spark, sf_dir):
    return sinks.export(R.docbox(frame(spark, sf_dir), grades=["C", "S"], todo=True)).drop("confidence")


@query(
    """WITH r AS (SELECT doc_id, 'D/' || source || '/' || doc_id AS file, md5(text) || md5(lang) AS hash FROM documents), o AS (SELECT doc_id AS line, CASE WHEN doc_id % 7 = 0 THEN doc_id END AS doc_id, CASE WHEN doc_id % 7 = 1 THEN left(md5(text) || md5(lang), 40) END AS hash40, CASE WHEN doc_id % 7 = 2 THEN upper('d/' || source || '/' || doc_id) END AS file, ['C', 'S', 'O'][doc_id % 3 + 1] AS new_grade FROM documents),
 byid AS (SELECT doc_id, arg_max(new_grade, line) AS g FROM o WHERE doc_id IS NOT NULL GROUP BY 1), byhash AS (SELECT hash40, arg_max(new_grade, line) AS g FROM o WHERE hash40 IS NOT NULL GROUP BY 1), byfile AS (SELECT lower(file) AS f, arg_max(new_grade, line) AS g, count(DISTINCT file) AS n FROM o WHERE file IS NOT NULL GROUP BY 1)
 SELECT r.doc_id, coalesce(byid.g, byhash.g, byfile.g) AS new_grade, CASE WHEN byid.g IS NOT NULL THEN 'doc_id' WHEN byhash.g IS NOT NULL THEN 'hash40' WHEN byfile.g IS NOT NULL THEN 'fold' END AS rematched_by FROM r LEFT JOIN byid USING (doc_id) LEFT JOIN byhash ON byhash.hash40 = left(r.hash, 40) LEFT JOIN byfile ON byfile.f = lower(r.file)"""
)
def override_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    whole = F.concat(F.md5(F.col("text").cast("binary")), F.md5(F.col("lang").cast("binary")))
    records = d.select("doc_id", F.concat_ws("/", F.lit("D"), "source", "doc_id").alias("file"), whole.alias("hash"))
    log = d.select(
        F.col("doc_id").alias("line"),
        F.when(F.col("doc_id") % 7 == 0, F.col("doc_id")).alias("doc_id"),
        F.when(F.col("doc_id") % 7 == 1, whole).alias("hash"),
        F.when(F.col("doc_id") % 7 == 2, F.upper(F.concat_ws("/", F.lit("d"), "source", "doc_id"))).alias("file"),
        F.get(F.array(F.lit("C"), F.lit("S"), F.lit("O")), (F.col("doc_id") % 3).cast("int")).alias("new_grade"),
    )
    log = R.keyed(log).withColumn("hash", F.lit(None).cast("string"))
    return R.resolved(R.keyed(records), log, list(R.KEYS), "new_grade").select("doc_id", "new_grade", "rematched_by")


# ---------------------------------------------------------------- seeds


@query(
    "WITH r AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'axis_off' WHEN label % 6 = 0 THEN 'short' WHEN vec_id % 7 = 0 THEN 'review' WHEN vec_id % 13 = 0 THEN 'unsure' WHEN label % 2 = 0 THEN 'no_leaf' ELSE 'ok' END AS reason FROM embeddings) SELECT reason, count(*) AS records FROM r GROUP BY 1"
)
def seed_reasons(spark, sf_dir):
    return S.selected(seed_records(spark, sf_dir), X.nodes(spark))[1]


def seed_records(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    label = F.struct(
        F.when(F.col("label") % 2 == 0, "A1").otherwise("B1").alias("dc_id"),
        F.when(F.col("vec_id") % 13 == 0, 0.5).otherwise(0.9).alias("confidence"),
        F.array(F.lit("title"), F.lit("head")).alias("sources"),
        F.lit("rule").alias("stage"),
        (F.col("vec_id") % 7 == 0).alias("review"),
    )
    return v.select(
        F.col("vec_id").cast("string").alias("file"), (F.col("vec_id") % 17).cast("string").alias("folder"), (F.col("vec_id") % 11 != 0).alias("doctype_on"), F.col("embedding").alias("vector"),
        F.array(label).alias("labels"), F.when(F.col("label") % 6 == 0, 100).otherwise(1000).alias("n_chars"),
    )


@query()
def seed_selection(spark, sf_dir):
    return S.selected(seed_records(spark, sf_dir), X.nodes(spark))[0]


SEEDS = "SELECT doc_id AS file, CASE WHEN doc_id % 3 = 0 THEN 'auto' WHEN doc_id % 3 = 1 THEN 'hand' END AS source, 'active' AS state FROM documents WHERE doc_id % 2 = 0"


def seed_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").selectExpr("doc_id AS file", "CASE WHEN doc_id % 3 = 0 THEN 'auto' WHEN doc_id % 3 = 1 THEN 'hand' END AS source", "'active' AS state")


@query(f"WITH s AS ({SEEDS}), n AS (SELECT doc_id AS file FROM labels WHERE toxic = 0), kept AS (SELECT file, source FROM s WHERE source IS DISTINCT FROM 'auto') SELECT file, coalesce(source, '-') AS source FROM kept UNION ALL SELECT file, 'auto' FROM n WHERE file NOT IN (SELECT file FROM kept)")
def seed_replace(spark, sf_dir):
    new = table(spark, sf_dir, "labels").filter("toxic = 0").selectExpr("doc_id AS file", "'active' AS state")
    return S.replaced(seed_rows(spark, sf_dir), new, "auto")[0].select("file", F.coalesce("source", F.lit("-")).alias("source"))


@query(
    f"WITH s AS ({SEEDS}), o AS (SELECT user_id AS file, arg_max(event_type, event_id) AS op FROM events GROUP BY 1) SELECT s.file, CASE o.op WHEN 'purchase' THEN 'retired' WHEN 'click' THEN 'suspect' ELSE s.state END AS state, CASE WHEN o.op IN ('purchase', 'click') THEN 'by ' || o.op END AS note FROM s LEFT JOIN o USING (file) WHERE o.op IS DISTINCT FROM 'view'"
)
def seed_edits(spark, sf_dir):
    op = F.when(F.col("event_type") == "purchase", "retire").when(F.col("event_type") == "click", "suspect").when(F.col("event_type") == "view", "remove").otherwise("restore")
    ops = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), op.alias("op"), F.concat(F.lit("by "), "event_type").alias("reason"))
    return S.edited(seed_rows(spark, sf_dir), ops, "file").select("file", "state", "note")


@query()
def seed_bulk_add(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("place", -F.col("vec_id"))
    from ..operators import vectors

    return vectors.greedy_distinct(v, v.filter("vec_id % 5 = 0").drop("place"), "vec_id", "embedding", "place", 0.45)


# ---------------------------------------------------------------- mining


@query(
    f"WITH {MINE_SQL} SELECT term, CASE WHEN docs >= 3 AND folders >= 2 AND round(df_neg, 9) <= 0.05 THEN 'strict' WHEN docs >= 3 AND round(df_pos, 9) >= 0.5 AND round(df_neg, 9) <= 0.02 THEN 'loose' WHEN docs < 3 THEN 'few_docs' WHEN folders < 2 THEN 'few_folders' ELSE 'too_common' END AS lane FROM f"
)
def term_lanes(spark, sf_dir):
    return mined(spark, sf_dir).select("term", M.lanes().alias("lane"))


TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^0-9a-z\x{{00e0}}-\x{{024f}}\x{{ac00}}-\x{{d7a3}}]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]') AND len(list_distinct(regexp_extract_all(w, '.'))) > 1 AND w NOT IN ('pdf', 'doc', 'docx', 'xls', 'xlsx', 'ppt', 'pptx', 'hwp', 'hwpx', 'txt', 'htm', 'html')))"


@query(
    f"WITH t AS (SELECT doc_id, {TOKENS.format('source')} AS n, {TOKENS.format('substring(text, 1, 400)')} AS h, {TOKENS.format('text')} AS b FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) "
    "SELECT doc_id, len(n) AS n_name, len(list_filter(h, lambda w: NOT list_contains(n, w))) AS n_head, len(list_filter(b, lambda w: NOT list_contains(n, w) AND NOT list_contains(h, w))) AS n_body FROM t"
)
def field_words(spark, sf_dir):
    d = documents(spark, sf_dir).filter("text IS NOT NULL AND source IS NOT NULL")
    f = M.fields(F.lit(""), F.col("source"), F.substring("text", 1, 400), F.col("text"))
    n = lambda c: F.size(F.col(f"f.{c}")).cast("long").alias(f"n_{c}")
    return d.select("doc_id", f.alias("f")).select("doc_id", n("name"), n("head"), n("body"))


@query(
    "WITH a AS (SELECT doc_id, ['q' || quality, 'x'] AS l FROM labels WHERE doc_id % 2 = 0), r AS (SELECT doc_id, ['t' || toxic] AS c, CASE WHEN quality = 1 THEN ['x', 'q1'] ELSE [] END AS d FROM labels WHERE doc_id % 3 = 0), j AS (SELECT doc_id, list_sort(list_filter(list_distinct(coalesce(l, []) || coalesce(c, [])), lambda x: NOT list_contains(coalesce(d, []), x))) AS labels FROM a FULL JOIN r USING (doc_id)) SELECT doc_id, array_to_string(labels, ',') AS labels FROM j WHERE len(labels) > 0"
)
def label_merge(spark, sf_dir):
    d = table(spark, sf_dir, "labels")
    approved = d.filter("doc_id % 2 = 0").selectExpr("doc_id", "array(concat('q', quality), 'x') AS labels")
    log = d.filter("doc_id % 3 = 0").selectExpr("doc_id", "array(concat('t', toxic)) AS confirmed", "CASE WHEN quality = 1 THEN array('x', 'q1') ELSE CAST(array() AS ARRAY<STRING>) END AS rejected")
    return M.merged_labels(approved, log, "doc_id").select("doc_id", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {MINE_SQL}, b AS (SELECT DISTINCT unnest({WORDS_SQL}) AS term FROM benchmark) SELECT term FROM f WHERE term NOT IN (SELECT term FROM b)")
def stopword_anti(spark, sf_dir):
    stop = table(spark, sf_dir, "benchmark").select(F.explode(M.words(F.col("text"))).alias("term"))
    return M.without_known(mined(spark, sf_dir), stop).select("term")


@query(
    f"WITH {MINE_SQL}, x AS (SELECT term, log_odds, CASE WHEN docs < 3 THEN 'few_docs' WHEN folders < 2 THEN 'few_folders' ELSE 'too_common' END AS reason FROM (SELECT *, round(ln((df_pos + 0.5 / greatest(n_pos, 1)) / (df_neg + 0.5 / greatest(n_neg, 1))), 9) AS log_odds FROM f) WHERE NOT (docs >= 3 AND folders >= 2 AND round(df_neg, 9) <= 0.05) AND NOT (docs >= 3 AND round(df_pos, 9) >= 0.5 AND round(df_neg, 9) <= 0.02)) "
    "SELECT reason, term FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY log_odds DESC, term) AS place FROM x) WHERE place <= 15"
)
def near_misses(spark, sf_dir):
    return M.below(mined(spark, sf_dir).withColumn("log_odds", F.round("log_odds", 9)), M.lanes()).select("reason", "term")


# ---------------------------------------------------------------- evaluation

SEC_SQL = GRADED_SQL.rstrip() + ", r2 AS (SELECT CASE WHEN toxic = 1 THEN 'C' WHEN quality = 1 THEN 'O' END AS t, grade AS p, 1.0::DOUBLE AS w FROM g JOIN labels USING (doc_id)), k2 AS (SELECT *, coalesce(CASE t WHEN 'C' THEN 3 WHEN 'S' THEN 2 WHEN 'O' THEN 1 END, -1) AS a, coalesce(CASE p WHEN 'C' THEN 3 WHEN 'S' THEN 2 WHEN 'O' THEN 1 END, -1) AS b FROM r2) "


@query(
    SEC_SQL
    + "SELECT round(sum(CASE WHEN t = 'C' AND p = 'C' THEN w ELSE 0 END) / nullif(sum(CASE WHEN t = 'C' THEN w ELSE 0 END), 0), 6) AS c_recall, round(sum(CASE WHEN t = 'C' AND p = 'C' THEN w ELSE 0 END) / nullif(sum(CASE WHEN p = 'C' THEN w ELSE 0 END), 0), 6) AS c_precision, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS exact, round(avg(CASE WHEN b > a THEN 1.0 ELSE 0 END), 6) AS over, round(avg(CASE WHEN b < a THEN 1.0 ELSE 0 END), 6) AS under FROM k2"
)
def security_verdict(spark, sf_dir):
    truth = F.when(F.col("toxic") == 1, "C").when(F.col("quality") == 1, "O")
    rows = graded(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select(truth.alias("truth"), F.col("security.grade").alias("predicted"))
    out = E.grades(E.weighted(rows, None, None))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    f"""WITH {CAND_SQL}, p AS (SELECT doc_id, list(dc_id) AS p FROM cand GROUP BY 1), r AS (SELECT CASE WHEN quality = 1 THEN ['A1'] WHEN toxic = 1 THEN [] ELSE ['B1', 'B2'] END AS t, coalesce(p, []) AS p, source FROM documents JOIN labels USING (doc_id) LEFT JOIN p USING (doc_id)),
 s AS (SELECT r.*, 1000.0::DOUBLE / count(*) OVER (PARTITION BY source) AS w, len(list_intersect(t, p)) AS i FROM r WHERE source IS NOT NULL)
 SELECT round(sum(i * w) / nullif(sum(len(p) * w), 0), 6) AS precision, round(sum(i * w) / nullif(sum(len(t) * w), 0), 6) AS recall, count(*) FILTER (i = len(t) AND i = len(p) AND i > 0) AS n_exact, count(*) FILTER (i > 0 AND NOT (i = len(t) AND i = len(p))) AS n_partial, count(*) FILTER (i = 0 AND len(t) > 0 AND len(p) > 0) AS n_wrong,
 count(*) FILTER (len(p) = 0 AND len(t) > 0) AS n_missed, count(*) FILTER (len(t) = 0 AND len(p) > 0) AS n_extra, count(*) FILTER (len(t) = 0 AND len(p) = 0) AS n_none FROM s"""
)
def doctype_verdict(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("source IS NOT NULL").join(table(spark, sf_dir, "labels"), "doc_id")
    said = typed(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("dc_id").alias("p"))
    none = F.array().cast("array<string>")
    truth = F.when(F.col("quality") == 1, F.array(F.lit("A1"))).when(F.col("toxic") == 1, none).otherwise(F.array(F.lit("B1"), F.lit("B2")))
    rows = d.join(said, "doc_id", "left").select("source", truth.alias("truth"), F.coalesce("p", none).alias("predicted"))
    out = E.doctypes(E.weighted(rows, "source", rows.select("source").distinct().withColumn("n", F.lit(1000))))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(
    r"""WITH p AS (SELECT doc_id, lang, text AS mine, regexp_replace(text, 'e[a-z]*', '', 'g') AS other FROM documents WHERE text IS NOT NULL), t AS (SELECT *, list_distinct(regexp_extract_all(lower(mine), '[0-9a-z\x{00e0}-\x{024f}\x{ac00}-\x{d7a3}]+')) AS a, list_distinct(regexp_extract_all(lower(other), '[0-9a-z\x{00e0}-\x{024f}\x{ac00}-\x{d7a3}]+')) AS b FROM p), i AS (SELECT *, len(list_intersect(a, b)) AS n, len(a) > 0 AND len(b) > 0 AS fine FROM t)
 SELECT lang, count(*) AS docs, count(*) FILTER (fine) AS compared, round(avg(CASE WHEN fine THEN n / len(b) END), 6) AS recall, round(avg(CASE WHEN fine THEN n / len(a) END), 6) AS precision, round(avg(CASE WHEN fine THEN n / (len(a) + len(b) - n) END), 6) AS jaccard, round(avg(CASE WHEN fine THEN length(mine) / length(other) END), 6) AS char_ratio, count(*) FILTER (len(a) = 0 AND len(b) > 0) AS only_other, count(*) FILTER (len(a) > 0 AND len(b) = 0) AS only_mine FROM i GROUP BY lang"""
)
def extraction_agreement(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("lang", F.col("text").alias("mine"), F.regexp_replace("text", "e[a-z]*", "").alias("other"))
    out = E.extraction_agreement(d, "lang")
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "jaccard", "char_ratio")})


@query(
    "WITH j AS (SELECT doc_id, quality = 1 AS good, toxic = 0 AS ok FROM labels), s AS (SELECT count(*) FILTER (good) AS good, count(*) FILTER (good AND NOT ok) AS thrown_out, count(*) FILTER (NOT good AND ok) AS let_in FROM j) SELECT good, thrown_out, let_in, round(thrown_out / good, 6) AS over_filter, thrown_out / good <= 0.10 AS passed FROM s"
)
def title_check(spark, sf_dir):
    d = table(spark, sf_dir, "labels")
    judged = d.select(F.col("doc_id").alias("dc_id"), F.when(F.col("toxic") == 0, "ok").otherwise("common").alias("verdict"))
    return E.title_check(judged, d.select(F.col("doc_id").alias("dc_id"), (F.col("quality") == 1).alias("good"))).withColumn("over_filter", F.round("over_filter", 6))


# ---------------------------------------------------------------- intake, logs, relations


def manifest_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("./x/../"), "source").alias("path"), F.coalesce("lang", F.lit("")).alias("sfile_id"), F.md5(F.col("text").cast("binary")).alias("hash"))


@query("SELECT source AS key, count(DISTINCT lang) AS ids FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY source HAVING count(DISTINCT lang) > 1")
def manifest_conflicts(spark, sf_dir):
    return files.conflicts(manifest_of(spark, sf_dir))


@query("SELECT 'd/' || doc_id AS path, CAST(doc_id AS VARCHAR) AS doc_id, 'file_missing' AS kind, 21 AS code FROM documents ANTI JOIN labels USING (doc_id)")
def missing_anti(spark, sf_dir):
    there = table(spark, sf_dir, "labels").select(F.concat(F.lit("d/./"), "doc_id").alias("path"))
    m = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.col("doc_id").cast("string").alias("sfile_id"))
    out = manifests.missing(m.withColumn("key", manifests.key(F.col("path"))), there)
    return out.select("path", "doc_id", "error.kind", "error.code")


@query("SELECT count(*) FILTER (d.source IS NULL) AS no_path, count(*) FILTER (d.source IS NOT NULL AND d.lang IS NULL) AS no_id FROM documents d")
def manifest_bad_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    m = manifest_of(spark, sf_dir).withColumn("path", F.when(F.col("path").endswith("/"), "").otherwise(F.col("path")))
    return files.manifest_counts(m, d.select(F.col("source").alias("path"), F.lit("").alias("hash"))).select("no_path", "no_id")


@query("SELECT page_id, lower(regexp_extract(list_last(str_split(url, '/')), '\\.([A-Za-z0-9]+)$', 1)) AS extension, length(html) > 3000 AS too_large FROM pages")
def size_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.length("html").alias("length"), "page_id")
    fit, over = files.gated(rows, 3000, 3000)
    fine = fit.select("page_id", files.extension(F.col("path")).alias("extension"), F.lit(False).alias("too_large"))
    rest = rows.join(fit.select("page_id"), "page_id", "left_anti").select("page_id", files.extension(F.col("path")).alias("extension"), F.lit(True).alias("too_large"))
    return fine.unionByName(rest)


@query(
    """WITH t AS (SELECT o_orderkey, CAST(round((o_totalprice - floor(o_totalprice)) * 86400) AS BIGINT) AS s, CAST(floor(o_totalprice / 8) AS BIGINT) AS d FROM orders), c AS (SELECT o_orderkey, d + CASE WHEN s >= 86400 THEN 1 ELSE 0 END AS d, s % 86400 AS s FROM t)
 SELECT o_orderkey, CASE WHEN d = 60 THEN '1900-02-29' ELSE strftime(DATE '1899-12-30' + CAST(CASE WHEN d < 60 THEN d + 1 ELSE d END AS INT), '%Y-%m-%d') END || ' ' || printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS t FROM c"""
)
def excel_times(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    serial = F.floor(F.col("o_totalprice") / 8) + (F.col("o_totalprice") - F.floor("o_totalprice"))
    return o.select("o_orderkey", extract.excel_text(serial, "both").alias("t"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return live.event_windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT e.event_id, o.o_orderkey FROM events e JOIN orders o ON o.o_custkey = e.user_id AND o.o_totalprice BETWEEN e.value * 1000 AND e.value * 1000 + 50000")
def interval_join(spark, sf_dir):
    """A band within equal keys: the band is a filter on the join's matches, never a comparison of all rows."""
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    return e.join(o, (o.o_custkey == e.user_id) & o.o_totalprice.between(e.value * 1000, e.value * 1000 + 50000)).select("event_id", "o_orderkey")


@query("SELECT doc_id, 'both' AS side FROM (SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT doc_id, 'toxic' FROM (SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT SELECT doc_id FROM labels WHERE quality = 0)")
def set_operations(spark, sf_dir):
    d = table(spark, sf_dir, "labels")
    a, b = d.filter("toxic = 1").select("doc_id"), d.filter("quality = 0").select("doc_id")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).distinct().withColumn("side", F.lit("toxic")))


@query()
def pii_all_counts(spark, sf_dir):
    """Every detector over every text, as it stands and folded; one row a label that occurs."""
    found = F.filter(pii.counts_through(F.col("text"), list(pii.DETECTORS)), lambda x: x["count"] > 0)
    return table(spark, sf_dir, "documents").select(F.inline(found)).groupBy("label").agg(F.sum("count").alias("n"), F.count("*").alias("docs"))


@query(
    f"WITH n AS (SELECT DISTINCT unnest({WORDS_SQL}) AS name FROM benchmark), e AS (SELECT name, right(name, k) AS suffix FROM n, range(2, 7) r(k) WHERE length(name) > k) SELECT suffix, count(*) AS kinds FROM e WHERE suffix IN (SELECT name FROM n WHERE length(name) BETWEEN 2 AND 6) GROUP BY 1 HAVING count(*) >= 2"
)
def suffix_mining(spark, sf_dir):
    return V.suffixes(table(spark, sf_dir, "benchmark").select(F.explode(M.words(F.col("text"))).alias("name")), "name")

