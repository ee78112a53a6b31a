"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units behind numbers and names become typed placeholders, one for each run
of them, lists of numbers included. Windows of the resulting templates are hash-joined, all of an item
and all of a document. A match names an alignment; along those that lie near each other the
whole item is compared with the document, so that an added or dropped word only moves the rest, and
the values in the slots are checked: a re-parameterised question puts the same new value wherever
the old one stood.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, named, pick, settle, sifted

WINDOW = 6
#: Beside an alignment that a window found, those so many tokens away count too, in runs of three.
NEAR = 3
#: Units that count as such behind a number.
UNITS = (
    "mm cm dm m km in ft yd mi miles mile meters metres meter metre feet foot inches inch g mg kg lb lbs oz tons ton grams gram pounds pound "
    "s sec secs seconds second min mins minutes minute h hr hrs hours hour days day weeks week months month years year "
    "l ml liters litres liter litre gallons gallon cups cup dollars dollar cents cent euros euro usd eur percent degrees degree mph kmh kph kw kwh w v hz"
).split()

#: Words that open sentences and are no names there; every other capitalised word is taken for one.
OPENERS = (
    "a an the this that these those he she it we you they his her its our their my your i in on at by of for from to with and but or nor so if when while "
    "after before then there here how what which who whose where why how many each every all some any no not as is are was were do does did can "
    "le la les un une des du de il elle nous vous ils elles ce cette ces et mais ou si quand comment quel quelle combien pourquoi dans sur pour avec "
    "der die das ein eine einen einem einer den dem er sie es wir ihr und aber oder wenn wie was wer wo warum viele im am auf mit von zu "
    "el los las una unos unas ella nosotros ellos ellas y pero o cuando como que cual cuanto cuantos cuánto cuántos qué cómo por en con"
).split()

QUANTITY, NAME, END = "\u0002", "\u0003", "\u0005"
# runs are possessive: a backtracking group would take a stack frame for each name of a long list
_NAME = rf"(?=\p{{Lu}})(?<!\p{{L}})(?!(?:{'|'.join(sorted(w.title() for w in OPENERS))})(?!\p{{L}}))\p{{L}}++(?<=\p{{Ll}})"
_NAMES = rf"{_NAME}(?:[\s-]{{1,2}}{_NAME})*+"
_NUMBER = r"\p{N}++(?:[.,]\p{N}++)*+"
_SIGN = r"[$€£¥%°]"
_PART = rf"(?=[$%0-9\u00a3-\x{{10ffff}}])(?:{_SIGN}|{_NUMBER}(?: ?(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\p{{L}}))?+)"
_QUANTITIES = rf"{_PART}(?:[ ,;|\t]*{_PART})*+"


#: Letters of scripts that put no blanks between words: Thai, Lao, Burmese, Khmer, Kana, Han.
_UNSPACED = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\x{20000}-\x{3ffff}&&\p{L}]"


def plain(text: Column) -> Column:
    """The text without the marks' own characters; in scripts without blanks each character is a word."""
    marks = f"[{QUANTITY}{NAME}{END}]"
    spaced = F.regexp_replace(F.regexp_replace(text, marks, " "), _UNSPACED, " $0 ")
    return F.when(text.rlike(rf"[{QUANTITY}{NAME}{END}\u0e00-\x{{10ffff}}]"), spaced).otherwise(text)


def template(text: Column) -> Column:
    """Words in lower case and placeholders."""
    bare = F.regexp_replace(F.regexp_replace(plain(text), _NAMES, NAME), _QUANTITIES, QUANTITY)
    return F.regexp_extract_all(F.lower(bare), F.lit(f"[{QUANTITY}{NAME}]|\\p{{L}}+"), 0)


def values(text: Column) -> Column:
    """As many tokens as the template has, slots with their values between marks."""
    named = F.regexp_replace(plain(text), _NAMES, f"{NAME}$0{END}")
    marked = F.regexp_replace(named, _QUANTITIES, f"{QUANTITY}$0{END}")
    return F.regexp_extract_all(F.lower(marked), F.lit(f"[{QUANTITY}{NAME}][^{END}]*{END}|\\p{{L}}+"), 0)


def placed(tokens: str) -> str:
    """The template of ``values``."""
    return f"transform({tokens}, v -> if(left(v, 1) IN ('{QUANTITY}', '{NAME}'), left(v, 1), v))"


def bare(tokens: str) -> str:
    """``values`` without marks."""
    return f"transform({tokens}, v -> translate(v, '{QUANTITY}{NAME}{END}', ''))"


def weights(tokens: str) -> str:
    """How many names, numbers, units or words each of ``values`` stands for."""
    return rf"transform({tokens}, v -> size(regexp_extract_all(v, r'\p{{L}}+|{_NUMBER}|{_SIGN}', 0)))"


def value(v: str) -> str:
    """A slot's value: the numbers of a quantity, however its units are written, or the name."""
    return rf"if({v} rlike r'\p{{N}}', trim(regexp_replace({v}, r'[^\p{{N}}.,]+', ' ')), trim(regexp_replace({v}, r'[{QUANTITY}{NAME}{END}\s-]+', ' ')))"


def exact(text: Column) -> Column:
    """Words, numbers and signs in lower case as they stand, for items too short for anything else."""
    return F.regexp_extract_all(F.lower(plain(text)), F.lit(rf"{_NUMBER}|{_SIGN}|\p{{L}}+"), 0)


def stretches(rows: DataFrame, tokens: str, lengths: list[int], *keep: str) -> DataFrame:
    """Rows (keep..., at, length, words) for every stretch of so many tokens."""
    each = [
        f"transform(if(size({tokens}) >= {n}, sequence(0, size({tokens}) - {n}), array()), i -> named_struct('at', i, 'length', {n}, 'words', array_join(slice({tokens}, i + 1, {n}), ' ')))"
        for n in lengths
    ]
    return rows.select(*keep, F.inline(F.expr(f"concat({', '.join(each)})")))


def short_leaks(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """Leaks of items (item_id, item_e) that are looked for word for word, with all of their values.

    One or two words are everyday speech: they leak only where they are the whole text.
    """
    lengths = [x[0] for x in items.select(F.size("item_e").alias("n")).filter("n > 0").distinct().orderBy("n").collect()]
    if not lengths:
        return keyed.select("doc_key", F.lit(0).cast("long").alias("item_id"), *as_found(F.lit(0))).limit(0)
    sought = items.select("item_id", F.array_join("item_e", " ").alias("words"), F.size("item_e").alias("length"))
    sought, _ = settle(sought)  # written, so that Spark knows its size when it chooses how to join
    texts = keyed.select("doc_key", exact(F.col("text")).alias("tokens"))
    long = [n for n in lengths if n > 2]
    whole = texts.select("doc_key", F.array_join("tokens", " ").alias("words"), F.size("tokens").alias("length")).filter("length <= 2")
    places = stretches(texts, "tokens", long, "doc_key").select("doc_key", "words", "length").unionByName(whole) if long else whole
    met = places.join(sought, ["words", "length"]).select("doc_key", "item_id", "length").distinct()
    return met.select("doc_key", "item_id", *as_found(F.col("length")))


def as_found(n: Column) -> list[Column]:
    return [n.alias("matched"), n.alias("item_tokens"), F.lit(True).alias("slots_consistent")]


def hit_texts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_key, text of the texts whose key is among ``keys``, each text once.

    Equal texts are put together where they are read, so copies move as one.
    """
    keyed = texts.select(F.md5(F.col("text").cast("binary")).alias("doc_key"), "text")
    may = sifted(keyed, F.col("doc_key"), keys, F.col("doc_key"))
    once = may.groupBy("doc_key").agg(F.first("text").alias("text"))
    return once.join(keys.hint("shuffle_hash"), "doc_key", "left_semi")


def windowed(rows: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """Rows (keep..., at, hash) for every window."""
    # no filter on the size: Spark would push it down and take the text apart twice
    both = "(a, b) -> xxhash64(a, b)"
    n = rows.select(*keep, F.size(tokens).alias("n"), F.expr(f"zip_with({tokens}, slice({tokens}, 2, size({tokens})), {both})").alias("two"))
    six = f"zip_with(zip_with(two, slice(two, 3, n), {both}), slice(two, 5, n), {both})"
    return n.select(*keep, F.posexplode(F.expr(f"slice({six}, 1, greatest(n - {WINDOW - 1}, 0))")).alias("at", "hash"))


def read_twice(items: DataFrame) -> DataFrame:
    """The items' windows with names as placeholders, and with single names as the words they may be.

    A window of placeholders alone says nothing and would meet every list of names.
    """
    has_word = f"exists(slice(item_t, at + 1, {WINDOW}), t -> t NOT IN ('{QUANTITY}', '{NAME}'))"
    words = items.withColumn("item_t", F.expr(rf"zip_with(item_v, item_p, (v, p) -> if(v rlike r'^{NAME}\p{{L}}+{END}$', p, if(left(v, 1) IN ('{QUANTITY}', '{NAME}'), left(v, 1), v)))"))
    both = windowed(items, "item_t", "item_id", "item_t").filter(has_word).unionByName(windowed(words, "item_t", "item_id", "item_t").filter(has_word))
    return both.drop("item_t")


def compared() -> Column:
    """For each choice of alignments, the item's tokens: (t, weight, same, was, now).

    A choice is one alignment, or all from one on that lie no further away than the item is long; with
    the latter go the neighbours of each. Tokens are the same by their template or by their words, as a name
    may stand where the other text has a small letter. Where several fit a token, that which fits most around it counts.
    """
    same = "(get(doc_t, {i} + {x}) = get(item_t, {i}) OR get(doc_p, {i} + {x}) = get(item_p, {i}))"
    run = " OR ".join("(" + " AND ".join(same.format(i=f"(i + {a + k})", x="x") for k in range(3)) + ")" for a in (-2, -1, 0))
    alone = "transform(shifts, s -> named_struct('found', array(s), 'all', array(s)))"
    together = (
        "transform(array_distinct(transform(shifts, s -> filter(shifts, x -> x BETWEEN s AND s + size(item_t)))), g -> "
        f"named_struct('found', g, 'all', array_distinct(flatten(transform(g, s -> sequence(s - {NEAR}, s + {NEAR}))))))"
    )
    fits = f"filter(g.all, x -> {same.format(i='i', x='x')} AND (array_contains(g.found, x) OR {run}))"
    around = f"size(filter(sequence(i - {NEAR}, i + {NEAR}), j -> {same.format(i='j', x='x')}))"
    best = f"array_max(transform({fits}, x -> named_struct('around', {around}, 'x', x))).x"
    line = f"transform(transform(item_t, (t, i) -> named_struct('t', t, 'i', i, 'x', {best})), y -> named_struct('t', y.t, 'weight', get(item_w, y.i), 'same', y.x IS NOT NULL, 'was', get(item_v, y.i), 'now', get(doc_v, y.i + y.x)))"
    return F.expr(f"transform(concat({alone}, {together}), g -> {line})")


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, least: int = 8) -> tuple[DataFrame, Callable[[], None]]:
    """doc_key, item_id, matched, item_tokens, slots_consistent: one row for each leaked item of a text.

    The second value removes what was written for it. doc_key is the text's md5. Names, numbers, units
    and words are counted. An item counts as leaked where at least ``share`` of them and ``least`` of
    them stand in the document along alignments near each other, and its slots' values map
    consistently (an old value has one new value wherever it stood); without that, nine tenths of its
    words must match. Six template tokens in a row, a word among them, are always found. An item of
    fewer than ``least``, of fewer template tokens than a window or without a word is looked for
    word for word. Null and empty texts and items leak nothing. Repeated items each count.
    """
    items = pick(benchmark, "item_id", "text").filter("text IS NOT NULL").select("item_id", "text", values(F.col("text")).alias("item_v"))
    items = items.select("item_id", "text", "item_v", F.expr(placed("item_v")).alias("item_t"), F.expr(bare("item_v")).alias("item_p"), F.expr(weights("item_v")).alias("item_w"))
    items = items.withColumn("item_tokens", F.expr("aggregate(item_w, 0, (a, w) -> a + w)"))
    has_word = F.exists("item_t", lambda t: ~t.isin(QUANTITY, NAME))
    long = (F.col("item_tokens") >= least) & (F.size("item_t") >= WINDOW) & has_word
    short = items.filter(~long).select("item_id", exact(F.col("text")).alias("item_e"))
    items = items.filter(long).drop("text")
    # written, so that Spark knows its size when it chooses how to join
    index, drop_index = settle(read_twice(items).select("item_id", F.col("at").alias("item_at"), "hash").distinct())
    texts = pick(docs, "text").filter("text IS NOT NULL")
    keyed = texts.select(F.md5(F.col("text").cast("binary")).alias("doc_key"), template(F.col("text")).alias("tokens"))
    met = windowed(keyed, "tokens", "doc_key").join(index, "hash")
    found, drop_found = settle(met.groupBy("doc_key", "item_id").agg(F.sort_array(F.collect_set(F.col("at") - F.col("item_at"))).alias("shifts")))
    drop_index()

    own = hit_texts(texts, found.select("doc_key").distinct())
    own = own.select("doc_key", values(F.col("text")).alias("doc_v"))
    own = own.select("doc_key", "doc_v", F.expr(placed("doc_v")).alias("doc_t"), F.expr(bare("doc_v")).alias("doc_p"))
    lined = found.join(own.hint("shuffle_hash"), "doc_key").join(items, "item_id")
    lined = lined.select("doc_key", "item_id", "item_tokens", F.explode(compared()).alias("line"))
    same = "filter(line, x -> x.same)"
    slots = f"filter(line, x -> x.same AND x.t IN ('{QUANTITY}', '{NAME}'))"
    words = f"filter(line, x -> x.t NOT IN ('{QUANTITY}', '{NAME}'))"
    was, now = value("x.was"), value("x.now")
    judged = lined.select(
        "doc_key",
        "item_id",
        F.expr(f"aggregate({same}, 0, (a, x) -> a + x.weight)").alias("matched"),
        "item_tokens",
        F.expr(
            f"size(array_distinct(transform({slots}, x -> named_struct('was', {was}, 'now', {now})))) = size(array_distinct(transform({slots}, x -> {was})))"
        ).alias("slots_consistent"),
        F.expr(f"size(filter({words}, x -> x.same)) / greatest(size({words}), 1)").alias("words_share"),
    )
    judged = judged.filter(
        (F.col("matched") >= share * F.col("item_tokens"))
        & (F.col("matched") >= least)
        & (F.col("slots_consistent") | (F.col("words_share") >= 0.9))
    )
    best = judged.groupBy("doc_key", "item_id").agg(F.max(F.struct("matched", "slots_consistent", "item_tokens")).alias("b"))
    best = best.select("doc_key", "item_id", "b.matched", "b.item_tokens", "b.slots_consistent")
    every = best.unionByName(short_leaks(texts.select(F.md5(F.col("text").cast("binary")).alias("doc_key"), "text"), short))
    out, drop = settle(every)
    drop_found()
    return out, drop


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, item_tokens, slots_consistent for every row that holds an item.

    Repeated rows repeat; null texts hold none; empty tables give none.
    """
    rows = pick(docs, "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.md5(F.col("text").cast("binary")).alias("doc_key"))
    found, _ = leaks(docs, benchmark)
    return rows.join(found.hint("shuffle_hash"), "doc_key").select(
        "doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("item_tokens").cast("long").alias("item_tokens"), "slots_consistent"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a leaked item, all columns kept, whatever their names.

    Null texts stay; repeated rows stay or go together; an empty table stays one.
    """
    found, drop = leaks(docs, benchmark)
    keys, _ = settle(found.select("doc_key").distinct())
    drop()
    flat, at = by_place(docs)
    keyed = flat.withColumn("doc_key", F.md5(F.col(at["text"]).cast("binary")))
    return named(keyed.join(keys, "doc_key", "left_anti"), docs.columns)
