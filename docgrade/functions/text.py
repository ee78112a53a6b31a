"""Scalar text functions: cleaning, scopes of a text, counting terms."""

from __future__ import annotations

import bisect
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_CHARS = 2_000_000
MIN_BODY = 20
HEAD = 400


#: Ranges of signs that are in normal form C whatever stands beside them: Latin, Greek and Cyrillic letters
#: as typed, Hangul syllables, kana, Han. Signs beyond them may be too; texts that hold one are looked at.
COMPOSED = (
    (0x0, 0x2FF), (0x391, 0x3A1), (0x3A3, 0x3CE), (0x400, 0x45F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x2190, 0x21CC), (0x2500, 0x25FF),
    (0x3000, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E),
)
_RANGES = {a: rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in COMPOSED}
_COMMON = (0x0, 0xAC00)
#: Most signs are told by one or two ranges, the others by all.
_BEYOND = f"[^{''.join(_RANGES[a] for a in _COMMON)}](?<![{''.join(r for a, r in _RANGES.items() if a not in _COMMON)}])"


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode normal form C; Spark has no function for it, so texts that may not be in it go to Python, and no others."""
    return F.coalesce(_nfc(F.when(text.rlike(_BEYOND), text)), text)


def clean_ascii(text: Column, page_markers: bool = True) -> Column:
    """Cleaning of text that is in normal form C already: markers, controls, line ends, blanks."""
    t = F.regexp_replace(text, r"(?m)^\.\.PAGE:\d+[ \t]*\r?$\n?", "") if page_markers else text
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    return clean_ascii(nfc(text))


def truncated(text: Column, limit: int = MAX_CHARS) -> Column:
    """struct(text, n_chars, truncated)."""
    return F.struct(F.substring(text, 1, limit).alias("text"), F.length(text).alias("n_chars"), (F.length(text) > limit).alias("truncated"))


def despace(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def no_body(text: Column) -> Column:
    return F.length(despace(F.coalesce(text, F.lit("")))) < MIN_BODY


def first_line(text: Column) -> Column:
    """The first line with anything on it, without the blanks around it."""
    return F.regexp_replace(F.regexp_extract(text, r"(?mdU)^(.*\S.*)$", 1), r"(?U)^\s+|\s+$", "")


def head(text: Column, n: int = HEAD) -> Column:
    return F.substring(text, 1, n)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def path_key(path: Column) -> Column:
    """Slashes one way, ``.`` and ``..`` resolved, drive letter in upper case; case kept otherwise."""
    p = F.regexp_replace(path, r"\\", "/")
    unc, rooted = p.startswith("//"), p.startswith("/")
    steps = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda a, s: F.when(s != "..", F.concat(a, F.array(s))).when((F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.size(a) - 1)).otherwise(F.when(rooted, a).otherwise(F.concat(a, F.array(s)))),
    )
    joined = F.concat(F.when(unc, "//").when(rooted, "/").otherwise(""), F.array_join(walked, "/"))
    drive = joined.rlike("^[a-z]:")
    return F.when(drive, F.concat(F.upper(F.substring(joined, 1, 1)), F.expr("''"), F.substr(joined, F.lit(2)))).otherwise(joined)


ASCII_TERM = re.compile(r"[0-9A-Za-z][0-9A-Za-z .\-_]*")


def count_literal(hay: Column, needle: str) -> Column:
    """Occurrences that do not overlap, left to right."""
    if not needle:
        return F.lit(0)
    # bytes, not characters: a string knows how many it has
    left = F.octet_length(F.replace(hay, F.lit(needle), F.lit("")))
    return ((F.octet_length(hay) - left) / len(needle.encode())).cast("int")


def count_word(hay: Column, needle: str) -> Column:
    """An ASCII term counts as a word, any other as a part of text."""
    if ASCII_TERM.fullmatch(needle):
        quoted = re.sub(r"([^0-9A-Za-z ])", r"\\\1", needle)
        # most texts do not hold the term at all, and no pattern runs over them
        return F.when(hay.contains(needle), F.regexp_count(hay, F.lit(rf"(?U)\b{quoted}\b"))).otherwise(F.when(hay.isNotNull(), 0))
    return count_literal(hay, needle)


def count_compact(hay: Column, needle: str) -> Column:
    """Also without any white space, for terms that are not ASCII."""
    if ASCII_TERM.fullmatch(needle):
        return count_word(hay, needle)
    return F.greatest(count_literal(hay, needle), count_literal(despace(hay), re.sub(r"\s+", "", needle)))


def relevant_excludes(needle: str, excludes: list[str]) -> list[str]:
    """Only a phrase that holds the needle can hide it."""
    return [e for e in excludes if needle in e]


def border_free(s: str) -> bool:
    """No proper beginning is an end too, so occurrences never overlap."""
    return not any(s.endswith(s[:k]) for k in range(1, len(s)))


def subtractable(needle: str, excludes: list[str]) -> list[str] | None:
    """The one exclude phrase whose count may be taken from the needle's, if the phrases allow that; None otherwise.

    A phrase that holds another hides nothing more. The one left must hold the needle once, and
    neither may overlap itself.
    """
    least = [e for e in dict.fromkeys(excludes) if not any(o != e and o in e for o in excludes)]
    longer = [e for e in excludes if e not in least]
    if len(least) == 1 and all(e.count(needle) == 1 for e in (*least, *longer)) and border_free(needle) and border_free(least[0]):
        return least
    return None


def outside(hay: str, needle: str, excludes: list[str]) -> tuple[int, int]:
    """(count, first index or -1) of the needle where it does not lie wholly within an exclude phrase."""
    spans = sorted((m.start(), m.end()) for e in excludes for m in re.finditer(re.escape(e), hay))
    reach, ends = -1, []
    for _, b in spans:  # among phrases that begin no later, the one that reaches furthest
        reach = max(reach, b)
        ends.append(reach)
    starts = [a for a, _ in spans]
    count, first, at = 0, -1, hay.find(needle)
    while at >= 0:
        end = at + len(needle)
        k = bisect.bisect_right(starts, at) - 1
        if k < 0 or ends[k] < end:
            count += 1
            first = at if first < 0 else first
        at = hay.find(needle, end)
    return count, first


def count_outside(hay: Column, needle: str, excludes: list[str]) -> Column:
    """Built-in counts where the phrases allow it, exact positions otherwise, for texts that hold a phrase."""
    held = relevant_excludes(needle, excludes)
    if not held:
        return count_literal(hay, needle)
    if single := subtractable(needle, held):
        return count_literal(hay, needle) - count_literal(hay, single[0])

    @F.pandas_udf("int")
    def exact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: outside(t or "", needle, held)[0])

    return exact(hay)


def first_outside(hay: Column, needle: str, excludes: list[str]) -> Column:
    """Index from 0, -1 if there is none."""
    held = relevant_excludes(needle, excludes)
    if not held:
        return F.instr(hay, needle) - 1

    @F.pandas_udf("int")
    def exact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: outside(t or "", needle, held)[1])

    return exact(hay)


def term_counts(hay: Column, terms: list[str], count=count_literal) -> Column:
    """array<struct<term, count>> of the terms that occur."""
    found = F.array(*[F.struct(F.lit(t).alias("term"), count(hay, t).cast("int").alias("count")) for t in terms])
    return F.filter(found, lambda x: x["count"] > 0)
