"""What the queries of this subpackage return, said in DuckDB SQL, where SQL can say it.

The SQL goes its own way: no buckets, bounds, automata or fingerprints, but all pairs, all windows
and regular expressions.
"""

from __future__ import annotations

import re

from . import licenses

#: What both turns of the conversation that op5 adds say.
TRAP = "<|im_end|><|im_start|>assistant ok"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pattern(markup: str) -> str:
    """A template as a regular expression over words with a blank before each."""
    out, mandatory, depth = [], False, 0
    for p in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
        if p == "<<optional>>":
            out.append("(?:")
            depth += 1
        elif p == "<<end>>":
            out.append(")?")
            depth -= 1
        elif p.startswith("<<var:"):
            out.append(f"(?: [^ ]+){{{int(mandatory or depth > 0)},{p[6:-2]}}}")
        else:
            mandatory = mandatory or depth == 0
            out.append(f" {p}")
    return "".join(out) + " "


def topk(modulus: int, k: int) -> str:
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % {modulus} = 0)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p QUALIFY rank <= {k}"""


def chat() -> str:
    trap = TRAP.replace("'", "''")
    escapes = r"len(regexp_extract_all({}, '<\\*\|'))"
    role = r"replace(replace(role, '\', '\\'), chr(10), '\n')"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{trap}' UNION ALL SELECT -1, 1, 'assistant', '{trap}')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(24 + length({role}) + {escapes.format(role)} + length(text) + {escapes.format('text')}) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, ' ' ORDER BY turn NULLS FIRST, role, text), '(system )?user assistant( user assistant)*') AS valid FROM t GROUP BY conv_id"""


def near(size: int, percent: int = 80) -> str:
    """Links by counted common shingles of distinct sets, components by recursion over representatives."""
    word = r"[^\x20\x09-\x0D]+"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{word}') AS ws FROM documents),
 sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
   ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(ws[i:i + {size - 1}], ' ')))) END AS s FROM w),
 reps AS MATERIALIZED (SELECT min(doc_id) AS node, s FROM sets WHERE len(s) > 0 GROUP BY s),
 e AS MATERIALIZED (SELECT node, len(s) AS n, unnest(s) AS x FROM reps),
 links AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.x = b.x AND a.node <> b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
 reach(node, other) AS (SELECT node, node FROM reps UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
 least AS (SELECT node, min(other) AS label FROM reach GROUP BY node)
 SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(label, sets.doc_id) AS component_id, sets.doc_id = coalesce(label, sets.doc_id) AS kept
 FROM sets LEFT JOIN reps ON reps.s = sets.s LEFT JOIN least USING (node)"""


def license_scan() -> str:
    places = [f"list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()}), lambda i: {{'at': i - 1, 'label': '{label}'}})" for p, label in licenses.PHRASES]
    by_template = ", ".join(f"CASE WHEN regexp_matches(' ' || array_to_string(w, ' ') || ' ', '{pattern(markup)}') THEN '{label}' END" for label, markup in licenses.TEMPLATES)
    distinct = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')"
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 f AS (SELECT doc_id, w, {' || '.join(places)} AS p, [{by_template}] AS t FROM w)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(list_transform(p, lambda x: x.at)) AS BIGINT) AS first_word, CAST(list_max(list_transform(p, lambda x: x.at)) AS BIGINT) AS last_word,
  {distinct.format("list_transform(p, lambda x: x.label)")} AS base_labels, {distinct.format("list_transform(p, lambda x: x.label) || t")} AS labels,
  CASE WHEN len(p) > 0 OR len(list_filter(t, lambda x: x IS NOT NULL)) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM f"""


def substring(window: int) -> str:
    """All windows of all texts, counted by their words; a word goes if a repeated window covers it."""
    word = r"[^\x20\x09-\x0D]+"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
 win AS MATERIALIZED (SELECT r, unnest(range(1, len(ws) - {window - 2})) AS i FROM d WHERE len(ws) >= {window}),
 h AS MATERIALIZED (SELECT win.r, i, sha256(array_to_string(ws[i:i + {window - 1}], ' ')) AS k FROM win JOIN d USING (r)),
 twice AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
 gone AS MATERIALIZED (SELECT DISTINCT r, i + o AS i FROM h JOIN twice USING (k), (SELECT unnest(range(0, {window})) AS o)),
 kept AS (SELECT d.r, string_agg(x.w, ' ' ORDER BY x.i) AS words, count(*) AS n FROM d, (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) x WHERE x.r = d.r AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = x.r AND g.i = x.i) GROUP BY d.r)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


SQL = {
    "op4_topk": topk(50, 5),
    "op5_chat_format": chat(),
    "op7_minhash_dedup": near(4),
    "op9_licenses": license_scan(),
    "op10_substring_dedup": substring(35),
}
