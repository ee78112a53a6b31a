"""Review: overrides, effective values, queues, roll-ups, dashboards, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_key

WORST = {"C": 3, "S": 2, "O": 1}


def latest(log: DataFrame, key: str, line: str, *columns: str) -> DataFrame:
    """The last line of each key: one partial aggregate, no window."""
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), line).alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in columns])


def resolved(records: DataFrame, overrides: DataFrame, keys: list[str], value: str) -> DataFrame:
    """records with ``value`` and ``rematched_by``: the first key, in order, that finds an override."""
    out = records
    for k in keys:
        one = overrides.filter(F.col(k).isNotNull()).groupBy(k).agg(F.max_by(value, "line").alias(f"_{k}"))
        out = out.join(one, k, "left")
    by = F.lit(None).cast("string")
    for k in reversed(keys):
        by = F.when(F.col(f"_{k}").isNotNull(), k).otherwise(by)
    return out.withColumns({value: F.coalesce(*[F.col(f"_{k}") for k in keys]), "rematched_by": by}).drop(*[f"_{k}" for k in keys])


def confidence_bin(confidence: Column) -> Column:
    """Five bins of a fifth; the last is closed."""
    return F.least(F.floor(confidence / 0.2), F.lit(4)).cast("int")


def rolled_up(members: DataFrame, origin: str) -> DataFrame:
    """One row a container: the worst grade of its members and how many have each."""
    rank = F.coalesce(*[F.when(F.col("grade") == g, r) for g, r in WORST.items()], F.lit(0))
    worst = F.max(rank)
    out = F.lit(None).cast("string")
    for g, r in WORST.items():
        out = F.when(worst == r, g).otherwise(out)
    counts = [F.count_if(F.col("grade") == g).alias(f"n_{g.lower()}") for g in WORST]
    return members.groupBy(origin).agg(out.alias("grade"), *counts, F.count_if(F.col("grade").isNull()).alias("n_none"))


def precision_recall(rows: DataFrame, truth: str, predicted: str, weight: Column | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall; with a weight, estimates for the population."""
    w = F.lit(1.0) if weight is None else weight
    total = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    sums = rows.agg(total(t & p).alias("tp"), total(~t & p).alias("fp"), total(t & ~p).alias("fn"))
    return sums.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after, change: what is new, gone or different between two runs."""
    b = before.select(key, F.col(value).alias("before"), F.lit(True).alias("_b"))
    a = after.select(key, F.col(value).alias("after"), F.lit(True).alias("_a"))
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "gone").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return b.join(a, key, "full").select(key, "before", "after", change.alias("change")).filter("change IS NOT NULL")


def allocate(population: dict[str, int], total: int, floor: int = 0) -> dict[str, int]:
    """Sample sizes by stratum: floors first, then by the root of the population, largest remainders, capped."""
    out = {s: min(n, floor) for s, n in population.items()}
    while (left := total - sum(out.values())) > 0:
        open_ = {s: population[s] ** 0.5 for s in population if out[s] < population[s]}
        if not open_:
            break
        whole = sum(open_.values())
        share = {s: left * w / whole for s, w in open_.items()}
        add = {s: int(x) for s, x in share.items()}
        for s in sorted(share, key=lambda s: (add[s] - share[s], s))[: left - sum(add.values())]:
            add[s] += 1
        for s, n in add.items():
            out[s] = min(population[s], out[s] + n)
    return out


# ---------------------------------------------------------------- overrides in effect

KEYS = ("doc_id", "hash", "hash40", "file", "norm", "fold")


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, hash, file) with every key that an override may be found by; ``fold`` only where one row has it."""
    out = rows.withColumns({"hash40": F.left("hash", F.lit(40)), "norm": path_key(F.col("file"))}).withColumn("_fold", F.lower("norm"))
    once = out.filter("_fold IS NOT NULL").groupBy("_fold").agg(F.countDistinct("norm").alias("n")).filter("n = 1").select("_fold", F.col("_fold").alias("fold"))
    return out.join(once, "_fold", "left").drop("_fold")


def effective_grade(records: DataFrame) -> DataFrame:
    """records (grade, new_grade) with the grade in effect and whether a reviewer changed it."""
    now = F.coalesce("new_grade", "grade")
    return records.withColumns({"effective": now, "changed": F.col("new_grade").isNotNull() & ~F.col("new_grade").eqNullSafe(F.col("grade"))})


def effective_doctype(auto: Column, proposed: Column, confirmed: Column, rejected: Column, known: Column | None = None) -> Column:
    """array<struct<dc_id,status>>: confirmed, rejected, proposed and auto labels, and those a reviewer added by hand.

    A rejected label stays, as rejected; labels that the tree does not know (``known``) are left out.
    """
    none = F.array().cast("array<string>")
    a, p, c, r = (F.coalesce(x, none) for x in (auto, proposed, confirmed, rejected))
    every = F.array_distinct(F.concat(a, p, c, r))
    if known is not None:
        every = F.array_intersect(every, known)
    machine = F.array_union(a, p)

    def status(x: Column) -> Column:
        return (
            F.when(F.array_contains(r, x), "rejected")
            .when(F.array_contains(c, x), F.when(F.array_contains(machine, x), "confirmed").otherwise("manual"))
            .when(F.array_contains(p, x), "proposed")
            .otherwise("auto")
        )

    return F.transform(F.array_sort(every), lambda x: F.struct(x.alias("dc_id"), status(x).alias("status")))


def doctype_status(labels: Column) -> Column:
    """One word for a record's labels: confirmed, mixed, rejected, open, or none."""
    is_ = lambda *s: F.size(F.filter(labels, lambda x: x["status"].isin(*s)))
    done, gone, open_ = is_("confirmed", "manual"), is_("rejected"), is_("proposed", "auto")
    return F.when(F.size(labels) == 0, "none").when((done > 0) & (open_ == 0), "confirmed").when(done > 0, "mixed").when(open_ > 0, "open").otherwise("rejected")


def review_frame(records: DataFrame, low: float = 0.6, seeds: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """records (effective, confidence, held, labels) with need_sec (undecided and held back or unsure) and need_doc
    (labels a person has not settled); documents that are seeds need nothing."""
    need_sec = F.col("effective").isNull() & (F.coalesce("held", F.lit(False)) | (F.coalesce("confidence", F.lit(0.0)) < low))
    need_doc = F.exists("labels", lambda x: x["status"].isin("proposed", "auto"))
    out = records.withColumns({"need_sec": need_sec, "need_doc": need_doc})
    if seeds is not None:
        marks = seeds.select(key).distinct().withColumn("_seed", F.lit(True))
        out = out.join(marks, key, "left").withColumns({c: F.col(c) & F.col("_seed").isNull() for c in ("need_sec", "need_doc")}).drop("_seed")
    return out


def inbox(frame: DataFrame, most: int = 30, key: str = "doc_id") -> DataFrame:
    """What to look at first: both needs, then the grade, then the least sure."""
    both = F.col("need_sec") & F.col("need_doc")
    return frame.filter("need_sec OR need_doc").orderBy(both.desc(), F.col("need_sec").desc(), F.coalesce("confidence", F.lit(0.0)), key).limit(most)


def docbox(frame: DataFrame, grades: list[str] | None = None, name: str | None = None, roots: list[str] | None = None, todo: bool = False) -> DataFrame:
    """Filters of the list of documents; all that are given must hold. ``-`` among grades stands for none."""
    out = frame
    if grades:
        out = out.filter(F.coalesce("effective", F.lit("-")).isin(*grades))
    if name:
        out = out.filter(F.lower("file").contains(name.lower()))
    if roots:
        out = out.filter(F.arrays_overlap("roots", F.array(*[F.lit(r) for r in roots])))
    return out.filter("need_sec OR need_doc") if todo else out


def dashboard(frame: DataFrame) -> DataFrame:
    """One row of counters: documents by grade in effect, changed ones, needs."""
    grade = lambda g: F.count_if(F.coalesce("effective", F.lit("-")) == g).alias(f"n_{'none' if g == '-' else g.lower()}")
    return frame.agg(F.count("*").alias("docs"), *[grade(g) for g in ("C", "S", "O", "-")], F.count_if("changed").alias("n_changed"), F.count_if("need_sec").alias("n_need_sec"), F.count_if("need_doc").alias("n_need_doc"))


def by_root(labels: DataFrame, tree_closure: DataFrame, key: str = "doc_id") -> DataFrame:
    """root, docs: documents with a label under each root."""
    roots = tree_closure.filter("next IS NULL").select("dc_id", F.col("ancestor").alias("root"))
    return labels.join(roots, "dc_id").groupBy("root").agg(F.countDistinct(key).alias("docs"))
