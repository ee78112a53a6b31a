"""The security axis: hits of rules, signals, conservative fusion. All narrow, one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pii, text as T
from ..plans.policy import RANK, Policy

HIT = "struct<id:string,layer:string,count:int,grade:string,confidence:double,seed_eligible:boolean,capped_from:string>"


def rank(grade: Column) -> Column:
    out = F.lit(0)
    for g, r in RANK.items():
        out = F.when(grade == g, r).otherwise(out)
    return out


def grade_of(rank_: Column) -> Column:
    out = F.lit(None).cast("string")
    for g, r in RANK.items():
        out = F.when(rank_ == r, g).otherwise(out)
    return out


def hit(id_: str, layer: str, count: Column, grade: Column, confidence: float, seed: bool, capped: Column | None = None) -> Column:
    return F.struct(
        F.lit(id_).alias("id"),
        F.lit(layer).alias("layer"),
        count.cast("int").alias("count"),
        grade.alias("grade"),
        F.lit(float(confidence)).alias("confidence"),
        F.lit(seed).alias("seed_eligible"),
        (F.lit(None).cast("string") if capped is None else capped).alias("capped_from"),
    ).cast(HIT)


def hits_of(candidates: list[tuple[Column, Column]]) -> Column:
    """The hits whose condition holds, in the rules' order."""
    if not candidates:
        return F.array().cast(f"array<{HIT}>")
    return F.filter(F.array(*[F.when(fires, h) for fires, h in candidates]), lambda h: h.isNotNull())


def escalated(count: Column, base: str, bulk: str | None, threshold: int) -> Column:
    return F.when(count >= threshold, bulk).otherwise(base) if bulk else F.lit(base)


def with_counts(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The counts that rules need, each literal and each detector once, as columns of their own."""
    hay = F.lower(F.coalesce(F.col(text), F.lit("")))
    out = docs.withColumn("_hay", hay)
    labels = list(dict.fromkeys([r.label for r in policy.regex] + [x for c in policy.combos for x in (*c.all_of, *c.of)]))
    return out.withColumns({f"_n_{label}": F.size(pii.DETECTORS[label].hits(F.coalesce(F.col(text), F.lit("")))) for label in labels})


def pii_hits(policy: Policy) -> Column:
    """Only the first rule of a label fires; many finds raise its grade; a cap lowers it, on record."""
    cands, seen = [], set()

    def capped(grade: Column) -> tuple[Column, Column | None]:
        if not policy.pii_grade_cap:
            return grade, None
        over = rank(grade) > RANK[policy.pii_grade_cap]
        return F.when(over, policy.pii_grade_cap).otherwise(grade), F.when(over, grade)

    for r in policy.regex:
        if r.label in seen:
            continue
        seen.add(r.label)
        n = F.col(f"_n_{r.label}")
        grade, was = capped(escalated(n, r.base_grade, r.bulk_grade, r.bulk_threshold or policy.bulk_threshold))
        cands.append((n > 0, hit(r.id, "L1", n, grade, r.confidence, r.seed_eligible, was)))
    for c in policy.combos:
        fires, n = F.lit(True), F.lit(0)
        if c.all_of:
            for label in c.all_of:
                fires = fires & (F.col(f"_n_{label}") > 0)
        if c.of and c.min_types:
            types = F.lit(0)
            for label in c.of:
                types = types + (F.col(f"_n_{label}") > 0).cast("int")
            fires = fires & (types >= c.min_types)
        for label in dict.fromkeys((*c.all_of, *c.of)):
            n = n + (F.col(f"_n_{label}") > 0).cast("int")
        if not c.all_of and not (c.of and c.min_types):
            continue
        grade, was = capped(F.lit(c.grade))
        cands.append((fires, hit(c.id, "COMBO", n, grade, c.confidence, c.seed_eligible, was)))
    return hits_of(cands)


def keyword_hits(policy: Policy) -> Column:
    cands = []
    for k in policy.keywords:
        total = F.lit(0)
        for t in k.terms:
            n = T.count_outside(F.col("_hay"), t, list(k.exclude))
            total = total + F.when(n >= k.term_min_count.get(t, 1), n).otherwise(0)
        cands.append((total > 0, hit(k.id, "L2", total, escalated(total, k.base_grade, k.bulk_grade, k.bulk_threshold or policy.bulk_threshold), k.confidence, k.seed_eligible)))
    return hits_of(cands)


def sensitive_hits(policy: Policy) -> Column:
    cands = []
    for r in policy.sensitive:
        total = sum((T.count_outside(F.col("_hay"), t, list(r.exclude)) for t in r.terms), F.lit(0))
        cands.append((total >= r.min_count, hit(r.id, "SENSITIVE", total, F.lit(r.grade), r.confidence, r.seed_eligible)))
    return hits_of(cands)


def stamp_mode(hay: Column, terms: tuple[str, ...], exclude: tuple[str, ...] = (), always: bool = False, head: int = T.HEAD) -> tuple[Column, Column]:
    """(mode or null, total): always, head+repeat, head or repeat."""
    total, at_head = F.lit(0), F.lit(False)
    for t in terms:
        total = total + T.count_outside(hay, t, list(exclude))
        first = T.first_outside(hay, t, list(exclude))
        at_head = at_head | ((first >= 0) & (first < head))
    mode = (
        F.when((total > 0) & F.lit(always), "always")
        .when(at_head & (total >= 2), "head+repeat")
        .when(at_head, "head")
        .when(total >= 2, "repeat")
    )
    return mode, total


def stamp_hits(policy: Policy) -> Column:
    cands = []
    for r in policy.stamps:
        mode, total = stamp_mode(F.col("_hay"), r.terms, r.exclude, r.always)
        cands.append((mode.isNotNull(), hit(r.id, "STAMP", total, F.lit(r.grade), r.confidence, r.seed_eligible)))
    return hits_of(cands)


def name_hits(policy: Policy, file: Column) -> Column:
    """The first term of each keyword rule that the file's name holds; never fit for seeds."""
    name = F.lower(T.basename(F.coalesce(file, F.lit(""))))
    cands = []
    for k in policy.keywords:
        if k.filename:
            fires = F.lit(False)
            for t in k.filename:
                fires = fires | (T.count_outside(name, t, list(k.exclude)) > 0)
            cands.append((fires, hit(k.id, "NAME", F.lit(1), F.lit(k.base_grade), policy.name_confidence, False)))
    return hits_of(cands)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signal(hits: Column) -> Column:
    """struct(grade, confidence, seed_eligible): the highest grade and what stands at it."""

    def made(ranked: Column) -> Column:
        top = ranked["top"]
        at = F.filter(ranked["hits"], lambda h: rank(h["grade"]) == top)
        return F.struct(
            grade_of(top).alias("grade"),
            F.coalesce(F.array_max(F.transform(at, lambda h: h["confidence"])), F.lit(0.0)).alias("confidence"),
            F.exists(at, lambda h: h["seed_eligible"]).alias("seed_eligible"),
        )

    ranked = let(hits, lambda h: F.struct(h.alias("hits"), F.array_max(F.transform(h, lambda x: rank(x["grade"]))).alias("top")))
    return let(ranked, made)


def fuse(signals: dict[str, Column], failsafe: str | None = None) -> Column:
    """struct(grade, confidence, seed_eligible, method, decided_by): signals can only raise a grade."""

    def entry(name: str, s: Column) -> Column:
        return let(s, lambda x: F.struct(F.lit(name).alias("name"), rank(x["grade"]).alias("rank"), x["confidence"].alias("confidence"), x["seed_eligible"].alias("seed_eligible")))

    def winners(each: Column) -> Column:
        top = F.array_max(F.transform(each, lambda x: x["rank"]))
        return let(top, lambda t: F.struct(t.alias("top"), F.filter(each, lambda x: (x["rank"] == t) & (x["rank"] > 0)).alias("at")))

    def made(w: Column) -> Column:
        some, at = w["top"] > 0, w["at"]
        return F.struct(
            F.when(some, grade_of(w["top"])).otherwise(F.lit(failsafe).cast("string")).alias("grade"),
            F.when(some, F.array_max(F.transform(at, lambda x: x["confidence"]))).otherwise(F.lit(0.0)).alias("confidence"),
            F.when(some, F.exists(at, lambda x: x["seed_eligible"])).otherwise(F.lit(False)).alias("seed_eligible"),
            F.when(some, "max").otherwise(F.lit("failsafe_default" if failsafe else "unclassified")).alias("method"),
            F.transform(at, lambda x: x["name"]).alias("decided_by"),
        )

    return let(let(F.array(*[entry(n, s) for n, s in signals.items()]), winners), made)


def graded(docs: DataFrame, policy: Policy, file: str | None = None, text: str = "text", failsafe: str | None = None) -> DataFrame:
    """Every document with its hits, signals and fused grade; a failed text is graded by its name alone."""
    out = with_counts(docs, policy, text)
    out = out.withColumns(
        {
            "hits_rule": F.concat(pii_hits(policy), keyword_hits(policy)),
            "hits_sensitive": sensitive_hits(policy),
            "hits_stamp": stamp_hits(policy),
            "hits_name": name_hits(policy, F.col(file)) if file else hits_of([]),
        }
    )
    out = out.withColumns({f"signal_{n}": signal(F.col(f"hits_{n}")) for n in ("rule", "sensitive", "stamp", "name")})
    # one row is fused once, whatever reads the result: no filter, rank or count is worked out again
    out = out.withColumn("security", fuse({n: F.col(f"signal_{n}") for n in ("rule", "sensitive", "stamp", "name")}, failsafe))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def record(graded_docs: DataFrame, id_col: str | list[str], ts: Column) -> DataFrame:
    """The nested record: the decision on top, its reasons below."""
    return graded_docs.select(
        *([id_col] if isinstance(id_col, str) else id_col),
        F.col("security.grade").alias("grade"),
        F.struct(
            F.struct(
                F.col("security.confidence").alias("confidence"),
                F.col("security.method").alias("method"),
                F.col("security.decided_by").alias("decided_by"),
                F.col("security.seed_eligible").alias("seed_eligible"),
                F.struct(*[F.struct(F.col(f"signal_{n}").alias("signal"), F.col(f"hits_{n}").alias("hits")).alias(n) for n in ("rule", "sensitive", "stamp", "name")]).alias("signals"),
            ).alias("security")
        ).alias("why"),
        F.struct(ts.alias("ts")).alias("meta"),
    )


def simple(records: DataFrame, id_col: str) -> DataFrame:
    return records.select(id_col, "grade", F.col("why.security.confidence").alias("confidence"), F.array_join("why.security.decided_by", ",").alias("decided_by"))
