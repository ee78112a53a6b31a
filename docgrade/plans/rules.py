"""Rules of document types as generated files: building, lineage, changes, editing, copies."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import vocabulary as V


def digest(text: str) -> str:
    """Of a file's content, whatever its byte order mark and line ends."""
    return hashlib.sha256(text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").encode()).hexdigest()


def build(nodes: list[tuple], synonyms: dict[str, list[str]], inputs: dict[str, str], endings: tuple[str, ...] = (), broad: tuple[str, ...] = (), by_hand: dict[str, dict] | None = None) -> dict:
    """Rules of every node that carries one, from titles and synonyms, with the digests of what they were made of.

    nodes are (dc_id, parent, ord, title); roots with children carry none. A title that is no head word
    gives title terms, but no name terms. Rules written by hand replace those of their node.
    """
    parents = {n[1] for n in nodes}
    titles = [n[3] for n in nodes]
    rules = {}
    for dc_id, parent, _, title in nodes:
        if parent is None and dc_id in parents:
            continue
        words = V.variants(title.lower(), {k.lower(): [x.lower() for x in v] for k, v in synonyms.items()})
        verdict = V.judge(title, titles, endings, broad)
        rules[dc_id] = {"title": words, "head": words, "body": [], "name": V.variants(title.lower(), {}, filename=True) if verdict == "ok" else [], "judged": verdict}
    for dc_id, rule in (by_hand or {}).items():
        rules[dc_id] = rule | {"judged": "by_hand"}
    body = json.dumps(rules, ensure_ascii=False, sort_keys=True)
    return {"rules": rules, "made_of": {k: digest(v) for k, v in sorted(inputs.items())}, "body": digest(body)}


def staleness(built: dict, inputs: dict[str, str]) -> list[str]:
    """Inputs that changed, appeared or are gone since, and whether the rules were edited by hand."""
    now, then = {k: digest(v) for k, v in inputs.items()}, built["made_of"]
    out = [f"changed: {k}" for k in sorted(now.keys() & then.keys()) if now[k] != then[k]]
    out += [f"new: {k}" for k in sorted(now.keys() - then.keys())] + [f"gone: {k}" for k in sorted(then.keys() - now.keys())]
    if digest(json.dumps(built["rules"], ensure_ascii=False, sort_keys=True)) != built["body"]:
        out.append("edited")
    return out


def changes(before: DataFrame, after: DataFrame, key: str = "dc_id", words: str = "terms") -> DataFrame:
    """key, change (new, removed, changed), added, removed: what a new build does to each node."""
    none = F.array().cast("array<string>")
    b = before.select(key, F.col(words).alias("_b"))
    a = after.select(key, F.col(words).alias("_a"))
    j = b.join(a, key, "full")
    added = F.array_sort(F.array_except(F.coalesce("_a", none), F.coalesce("_b", none)))
    removed = F.array_sort(F.array_except(F.coalesce("_b", none), F.coalesce("_a", none)))
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "removed").when((F.size(added) > 0) | (F.size(removed) > 0), "changed")
    return j.select(key, change.alias("change"), added.alias("added"), removed.alias("removed")).filter("change IS NOT NULL")


def bumped(version: str) -> str:
    """The last number of a version, one higher; ``1`` behind a version without one."""
    m = re.search(r"(\d+)(?!.*\d)", version)
    return version[: m.start()] + str(int(m[1]) + 1) + version[m.end() :] if m else f"{version}.1".lstrip(".")


def edited(policy: dict, section: str, rows: list[dict]) -> dict:
    """The policy with a section's rules as given: by id changed or added, those not given gone; the version goes up if anything changed."""
    old = {r["id"]: r for r in policy.get(section) or ()}
    new = [old.get(r["id"], {}) | {k: v for k, v in r.items() if v is not None} for r in rows]
    if new == list(old.values()):
        return policy
    return policy | {section: new, "version": bumped(str(policy.get("version", "0")))}


def compared(source: dict[str, str], copy: dict[str, str], ledger: dict[str, str]) -> dict[str, str]:
    """path -> same, stale (the source moved on), edited (the copy was changed), missing or extra; the ledger holds digests of what was copied."""
    out = {}
    for path in sorted(source.keys() | copy.keys()):
        if path not in copy:
            out[path] = "missing"
        elif path not in source:
            out[path] = "extra"
        elif digest(copy[path]) == digest(source[path]):
            out[path] = "same"
        else:
            out[path] = "edited" if ledger.get(path) != digest(copy[path]) else "stale"
    return out
