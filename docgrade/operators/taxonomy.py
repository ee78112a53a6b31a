"""Taxonomies and the document-type axis."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: A two-rooted tree of seven nodes for tests and demonstrations: id, parent, order, title.
DEMO = [
    ("A", None, 1, "Legal"),
    ("A1", "A", 1, "Licenses"),
    ("A2", "A", 2, "Rights"),
    ("A11", "A1", 1, "Open licenses"),
    ("B", None, 2, "Security"),
    ("B1", "B", 1, "Tokens"),
    ("B2", "B", 2, "Networks"),
]
#: Terms by node for the demonstration tree: (node, title terms, head terms, body terms).
DEMO_RULES = [
    ("A1", (), ("license", "licensed"), ("license", "licensed")),
    ("A2", (), ("rights",), ("rights", "reserved")),
    ("A11", (), ("gnu", "apache", "mit license"), ("gnu", "apache")),
    ("B1", (), ("token", "password"), ("token", "password")),
    ("B2", ("mail",), ("mail",), ("mail", "example")),
]
WEIGHTS = {"title": 0.7, "head": 0.5, "body": 0.4, "name": 0.5}
#: Formats whose first line is no title.
UNTITLED = (".ppt", ".xls", ".xlsx")
NODE = "dc_id string, parent string, ord int, title string"


def nodes(spark: SparkSession, rows=DEMO) -> DataFrame:
    """The tree as a local relation: Arrow data this small stays in the plan, and no Python worker reads it."""
    names = [c.split()[0] for c in NODE.split(", ")]
    types = (pa.string(), pa.string(), pa.int32(), pa.string())
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))}), NODE)


class TaxonomyError(ValueError):
    pass


def validate(rows: list[tuple]) -> list[str]:
    """Repeated ids, parents that are not there, cycles: all of them."""
    parent, out = {}, []
    for dc, up, *_ in rows:
        if dc in parent:
            out.append(f"{dc}: twice")
        parent[dc] = up
    out += [f"{dc}: no parent {up}" for dc, up in parent.items() if up is not None and up not in parent]
    for dc in parent:
        seen, at = set(), dc
        while at is not None and at in parent and at not in seen:
            seen.add(at)
            at = parent[at]
        if at is not None and at in seen:
            out.append(f"{dc}: in a cycle")
    return out


def closure(tree: DataFrame, depth: int = 16) -> DataFrame:
    """dc_id, ancestor, distance, root: joined level by level until no level is left."""
    up = tree.select(F.col("dc_id").alias("ancestor"), F.col("parent").alias("next"))
    level = tree.select("dc_id", F.col("dc_id").alias("ancestor"), F.lit(0).alias("distance"), F.col("parent").alias("next"))
    out = level
    for _ in range(depth):
        level = level.filter("next IS NOT NULL").select("dc_id", F.col("next").alias("ancestor"), (F.col("distance") + 1).alias("distance")).join(up, "ancestor")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    else:
        raise TaxonomyError(f"deeper than {depth} levels, or a cycle")
    return out


def noisy_or(parts: Column) -> Column:
    return 1 - F.aggregate(parts, F.lit(1.0), lambda a, x: a * (1 - x))


def candidates(docs: DataFrame, rules=DEMO_RULES, t_low: float = 0.30, min_distinct: int = 2, min_count: int = 2, text: str = "text", file: str | None = None) -> DataFrame:
    """(columns of docs, dc_id, confidence, sources): scores of every rule that passes, long form.

    A rule's evidence: a term in the first line (but of spreadsheets and slides), one among the first
    characters, one in the file's name, or enough distinct and total finds in the body; the body
    alone is not enough. Title, head and name are also read without blanks. A rule is (node, title
    terms, head terms, body terms) and may have name terms behind.
    """
    name = F.lower(T.basename(F.coalesce(F.col(file), F.lit("")))) if file else F.lit("")
    titled = ~F.lit(False)
    for end in UNTITLED:
        titled = titled & ~F.endswith(name, F.lit(end))
    hay = F.lower(F.coalesce(F.col(text), F.lit("")))
    out = docs.withColumns({"_hay": hay, "_title": F.lower(T.first_line(F.coalesce(F.col(text), F.lit("")))), "_head": T.head(hay), "_name": name})
    # what a rule finds is worked out once, as columns, however often the score asks for it
    finds, made = {}, []
    total = lambda scope, terms, count: sum((count(F.col(scope), t) for t in terms), F.lit(0))
    for i, (_, title, head, body, *names) in enumerate(rules):
        finds[f"_t{i}"] = titled & (total("_title", title, T.count_compact) > 0)
        finds[f"_h{i}"] = total("_head", head, T.count_compact) > 0
        finds[f"_n{i}"] = total("_name", names[0] if names else (), T.count_compact) > 0
        finds[f"_b{i}"] = F.array(*[T.count_word(F.col("_hay"), t) for t in body]).cast("array<int>")
    out = out.withColumns(finds)
    for i, (node, *_) in enumerate(rules):
        in_title, in_head, in_name, found = (F.col(f"_{x}{i}") for x in "thnb")
        in_body = (F.size(F.filter(found, lambda n: n > 0)) >= min_distinct) & (F.aggregate(found, F.lit(0), lambda x, n: x + n) >= min_count)
        each = F.array(
            F.when(in_title, F.struct(F.lit("title").alias("source"), F.lit(WEIGHTS["title"]).alias("c"))),
            F.when(in_head, F.struct(F.lit("head").alias("source"), F.lit(WEIGHTS["head"]).alias("c"))),
            F.when(in_body, F.struct(F.lit("body").alias("source"), F.lit(WEIGHTS["body"]).alias("c"))),
            F.when(in_name, F.struct(F.lit("name").alias("source"), F.lit(WEIGHTS["name"]).alias("c"))),
        )
        parts = F.filter(each, lambda x: x.isNotNull())
        score = noisy_or(F.transform(parts, lambda x: x["c"]))
        made.append(
            F.when(
                (in_title | in_head | in_name) & (score >= t_low),
                F.struct(F.lit(node).alias("dc_id"), score.alias("confidence"), F.transform(parts, lambda x: x["source"]).alias("sources")),
            )
        )
    out = out.withColumn("_c", F.filter(F.array(*made), lambda x: x.isNotNull())).drop("_hay", "_title", "_head", "_name", *finds)
    return out.select(*docs.columns, F.inline("_c"))


def merge(cands: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each document and node: sources together; of the rows the strictly higher score's evidence, the first (by ``order``) on ties."""
    first = F.struct("confidence", -F.col(order)) if order else F.col("confidence")
    kept = [F.max_by("sources", first).alias("evidence")]
    return cands.groupBy(key, "dc_id").agg(F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), *kept)


def absorb(cands: DataFrame, tree_closure: DataFrame, key: str) -> DataFrame:
    """Without the nodes that have a matched node below them in the same document.

    A document's candidates, at most as many as the tree has nodes, come together once with all that
    lies above them.
    """
    none = F.array().cast("array<string>")
    ups = tree_closure.filter("distance > 0").groupBy("dc_id").agg(F.collect_set("ancestor").alias("_up"))
    rows = cands.join(F.broadcast(ups), "dc_id", "left")  # one row a node of the tree
    own = rows.groupBy(key).agg(F.collect_list(F.struct(*cands.columns)).alias("_c"), F.flatten(F.collect_list(F.coalesce("_up", none))).alias("_above"))
    return own.select(F.inline(F.filter("_c", lambda c: ~F.array_contains("_above", c["dc_id"]))))


def top_n(cands: DataFrame, key: str, n: int = 3, min_confidence: float = 0.0) -> DataFrame:
    """The n surest nodes of each document (ties to the smaller id) and how many more there were."""
    own = cands.filter(F.col("confidence") >= min_confidence)
    w = W.partitionBy(key)
    ranked = own.withColumn("place", F.row_number().over(w.orderBy(F.col("confidence").desc(), "dc_id"))).withColumn("n_all", F.count("*").over(w))
    return ranked.filter(F.col("place") <= n).withColumn("truncated", F.greatest(F.col("n_all") - n, F.lit(0))).drop("n_all")


def cross_branch(cands: DataFrame, tree_closure: DataFrame, key: str) -> DataFrame:
    """Documents whose nodes lie under more than one root."""
    roots = tree_closure.filter("next IS NULL").select("dc_id", F.col("ancestor").alias("root"))
    return cands.join(F.broadcast(roots), "dc_id").groupBy(key).agg(F.sort_array(F.collect_set("root")).alias("roots")).filter(F.size("roots") > 1)


def embed_merge(cands: DataFrame, embedded: DataFrame, key: str, cap: float = 0.6, tree: DataFrame | None = None) -> DataFrame:
    """New nodes at most at ``cap``; a node that rules found too rises to the embedding's score, uncapped.

    Nodes that the tree does not hold are left out of what is embedded.
    """
    if tree is not None:
        embedded = embedded.join(tree.select("dc_id"), "dc_id", "left_semi")
    e = embedded.select(key, "dc_id", F.col("confidence").alias("e"))
    both = cands.select(key, "dc_id", "confidence").join(e, [key, "dc_id"], "full")
    stage = F.when(F.col("confidence").isNull(), "embed").when(F.col("e").isNull(), "rule").otherwise("both")
    value = F.when(F.col("confidence").isNull(), F.least("e", F.lit(cap))).otherwise(F.greatest("confidence", F.coalesce("e", "confidence")))
    return both.select(key, "dc_id", value.alias("confidence"), stage.alias("stage"))


def or_by_name(cands: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """Candidates by rules, and those by the file's name for documents in which no rule fired."""
    rest = named.join(cands.select(key).distinct(), key, "left_anti").select(key, "dc_id", "confidence", F.array(F.lit("name_head")).alias("sources"), F.lit(True).alias("review"))
    return cands.select(key, "dc_id", "confidence", "sources", F.lit(False).alias("review")).unionByName(rest)


def drawers(tree: DataFrame) -> DataFrame:
    """Roots with children: they hold other types and carry no rule."""
    parents = tree.filter("parent IS NOT NULL").select(F.col("parent").alias("dc_id")).distinct()
    return tree.filter("parent IS NULL").join(parents, "dc_id", "left_semi")


def ruled(tree: DataFrame) -> DataFrame:
    """The nodes that may carry a rule."""
    return tree.join(drawers(tree).select("dc_id"), "dc_id", "left_anti")


STRATEGIES = {"doctype": ("top_n",), "security": ()}


def conflict_override(spec: str) -> dict[str, tuple[str, int]]:
    """``doctype=top_n:3``: how an axis resolves several labels. The security axis always takes the highest grade."""
    out = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        axis, _, rest = part.partition("=")
        name, _, n = rest.partition(":")
        if axis not in STRATEGIES:
            raise ValueError(f"no axis {axis!r}")
        if not STRATEGIES[axis]:
            raise ValueError(f"the strategy of the {axis} axis is fixed")
        if name not in STRATEGIES[axis] or not n.isdigit() or int(n) < 1:
            raise ValueError(f"{axis}: {rest!r} is no strategy")
        out[axis] = (name, int(n))
    return out


EXPORTED = "dc_id string, parent_dc_id string, order_num int, title string"


def from_export(nodes_: DataFrame) -> DataFrame:
    """The tree of an exported list of nodes (dc_id, parent_dc_id, order_num, title); an empty parent is none."""
    return nodes_.select("dc_id", F.nullif(F.col("parent_dc_id"), F.lit("")).alias("parent"), F.coalesce("order_num", F.lit(0)).alias("ord"), "title")


def from_paths(rules: DataFrame) -> DataFrame:
    """The tree that rules' paths imply: path_ids (ids from the root) beside path (titles joined by " > ")."""
    steps = F.arrays_zip(F.col("path_ids").alias("id"), F.split("path", " > ").alias("title"))
    rows = rules.select("path_ids", F.posexplode(steps).alias("at", "s"))
    rows = rows.select(F.col("s.id").alias("dc_id"), F.get("path_ids", F.col("at") - 1).alias("parent"), F.col("at").alias("depth"), F.col("s.title").alias("title"))
    one = rows.filter("dc_id IS NOT NULL").groupBy("dc_id").agg(F.min_by(F.struct("parent", "depth", "title"), F.struct("depth", "title")).alias("n"))
    return one.select("dc_id", "n.parent", F.col("n.depth").alias("ord"), "n.title")
