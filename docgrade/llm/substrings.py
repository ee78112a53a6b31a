"""Exact substring dedup by fixed-block anchors.

A window of 35 words, wherever it starts, holds a whole block of 18 words of its document's own
fixed grid. So the grid's blocks are the index, every rolling window of 18 words of every document
is a probe, and a window of 35 words can only occur twice if a block inside it meets a second
probe. Hits are extended: every window of full length that holds a hit block is compared by a 96-bit
fingerprint, and runs of repeated windows are the maximal exact repeats, whose words go. Extension
goes by windows, not from one pair of places to the next, since a frequent passage has too many pairs.

Texts that another row repeats whole lose all their words without any comparison; one row of each
stands for them where others are compared.

Hashes travel sorted, as differences, packed by task and by range of the hash: a value that a task
holds thousands of times travels once with a flag, so a frequent passage makes no large group, and
no pair of documents is ever formed. Answers travel back as bits in the order of what was asked.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, pieces, settle, sifted, tidy
from .wordhash import hashes, split, windows

WINDOW = 35
#: The longest block of a grid of which any window holds a whole one.
BLOCK = (WINDOW + 1) // 2
PROBE_BITS = 48
#: Characters of text in one unit of work: a unit is one row, and a writer holds a hundred rows before it looks at their size.
UNIT_CHARS = 500_000
_pack = zstandard.ZstdCompressor(level=1)
_unpack = zstandard.ZstdDecompressor()


def deflate(values: np.ndarray) -> bytes:
    """Rising 64-bit values as compressed byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return _pack.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def inflate(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def ranges(values: np.ndarray, bits: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``parts`` (a power of two) equal ranges of hashes sorted values lie in, and where each begins."""
    of = (values >> np.uint64(bits - (parts.bit_length() - 1))).astype(np.int64)
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    return of[begin], np.append(begin, len(values))


def key128(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def key64(key: bytes) -> int:
    """Texts that share it by chance are compared at more places than they need be, no more."""
    return int.from_bytes(key[:8], "big", signed=True)


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


PROBES = "part int, probes binary, twice binary, blocks binary, owners binary, numbers binary"


def probe_blobs(texts: list[str], parts: int) -> dict[str, list]:
    """For each range of hashes the probes and the grid blocks of some texts."""
    every, blocks, owners, numbers = [], [], [], []
    for t in texts:
        h = hashes(split(t))
        if len(h) < WINDOW:
            continue
        w = windows(h, BLOCK) >> np.uint64(64 - PROBE_BITS)
        every.append(w)
        own = w[::BLOCK]
        blocks.append(own)
        owners.append(np.full(len(own), key64(key128(t)), np.int64))
        numbers.append(np.arange(len(own), dtype=np.int32))
    out: dict[str, list] = {c.split()[0]: [] for c in PROBES.split(", ")}
    if not every:
        return out
    probes, count = np.unique(np.concatenate(every), return_counts=True)
    twice = count > 1
    b, o, n = np.concatenate(blocks), np.concatenate(owners), np.concatenate(numbers)
    order = np.argsort(b, kind="stable")
    b, o, n = b[order], o[order], n[order]
    which, at = ranges(probes, PROBE_BITS, parts)
    # every block is a probe too, so its range is among them
    edges = which.astype(np.uint64) << np.uint64(PROBE_BITS - (parts.bit_length() - 1))
    b_at = np.append(np.searchsorted(b, edges), len(b))
    for part, i, j, k, m in zip(which.tolist(), at[:-1], at[1:], b_at[:-1], b_at[1:], strict=True):
        out["part"].append(part)
        out["probes"].append(deflate(probes[i:j]))
        out["twice"].append(np.packbits(twice[i:j]).tobytes())
        out["blocks"].append(deflate(b[k:m]))
        out["owners"].append(o[k:m].tobytes())
        out["numbers"].append(n[k:m].tobytes())
    return out


def by_part(batches):
    """(part, its rows as dicts) of a partition sorted by part."""
    rows = (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
    return itertools.groupby(rows, key=lambda r: r["part"])


def units(texts: list):
    """Index ranges of about UNIT_CHARS characters, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > UNIT_CHARS:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def hit_blocks(docs: DataFrame, parts: int) -> DataFrame:
    """key64 of a text and the numbers of its grid blocks that a second probe meets, anywhere."""

    def ask(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = [t or "" for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_pydict(probe_blobs(texts, parts), schema=SCHEMA_PROBES)
        tidy()

    def answer(batches):
        for _, rows in by_part(batches):
            values, flags, blocks, owners, numbers = [], [], [], [], []
            for r in rows:
                v = inflate(r["probes"])
                values.append(v)
                flags.append(v[np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(v)).astype(bool)])
                if r["owners"]:
                    blocks.append(inflate(r["blocks"]))
                    owners.append(np.frombuffer(r["owners"], np.int64))
                    numbers.append(np.frombuffer(r["numbers"], np.int32))
            if not blocks:
                continue
            v = np.sort(np.concatenate(values))
            again = np.unique(np.concatenate([v[1:][v[1:] == v[:-1]], *flags]))
            b = np.concatenate(blocks)
            hit = again[np.minimum(np.searchsorted(again, b), len(again) - 1)] == b if len(again) else np.zeros(len(b), bool)
            if hit.any():
                yield pa.RecordBatch.from_pydict(
                    {"key": pa.array(np.concatenate(owners)[hit]), "block": pa.array(np.concatenate(numbers)[hit])}
                )
        tidy()

    asked = docs.select("text").mapInArrow(ask, PROBES)
    found = asked.repartition("part").sortWithinPartitions("part").mapInArrow(answer, "key long, block int")
    return found.groupBy("key").agg(F.collect_set("block").alias("blocks"))


SCHEMA_PROBES = pa.schema(
    [("part", pa.int32()), ("probes", pa.binary()), ("twice", pa.binary()), ("blocks", pa.binary()), ("owners", pa.binary()), ("numbers", pa.binary())]
)


def fingerprints(texts: list[str], blocks: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows that hold a hit block: 64 and 32 bits of fingerprint, the text's index, the first word."""
    f1, f2, of, at = [], [], [], []
    for i, (t, own) in enumerate(zip(texts, blocks, strict=True)):
        h = hashes(split(t))
        n = len(h) - WINDOW + 1
        if n <= 0:
            continue
        near = np.zeros(n + 1, np.int32)
        starts = np.asarray(own, np.int64) * BLOCK
        np.add.at(near, np.clip(starts - (WINDOW - BLOCK), 0, n), 1)
        np.add.at(near, np.clip(starts + 1, 0, n), -1)
        where = np.flatnonzero(np.cumsum(near[:n]) > 0)
        f1.append(windows(h, WINDOW)[where])
        f2.append((windows(h, WINDOW, 0xC2B2AE3D27D4EB4F)[where] >> np.uint64(32)).astype(np.uint32))
        of.append(np.full(len(where), i, np.int32))
        at.append(where)
    if not f1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(f1), np.concatenate(f2), np.concatenate(of), np.concatenate(at)


def distinct(f1: np.ndarray, f2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by fingerprint, and the places in that order where a new fingerprint begins."""
    order = np.lexsort((f2, f1))
    a, b = f1[order], f2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


UNITS = "unit long, keys array<binary>, texts array<string>, blocks array<array<int>>"


def hit_units(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of ``wanted`` (key, key64, doc_id, blocks), packed into numbered units of bounded size."""

    def own_key(batches):
        seen: set[tuple] = set()  # a task hands on each of its rows once
        for batch in batches:
            for part in pieces(batch, "text"):
                out: dict[str, list] = {"key": [], "key64": [], "doc_id": [], "text": []}
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    key = key128(t or "")
                    if (key, i) not in seen:
                        seen.add((key, i))
                        for name, v in (("key", key), ("key64", key64(key)), ("doc_id", i), ("text", t or "")):
                            out[name].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=SCHEMA_KEYED)
        tidy()

    keyed = sifted(docs.mapInArrow(own_key, "key binary, key64 long, doc_id long, text string"), F.col("key64"), wanted, F.col("key64"))
    w = wanted.select(F.col("key").alias("w_key"), F.col("doc_id").alias("w_id"), "blocks").hint("shuffle_hash")
    joined = keyed.join(w, (F.col("key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("text", "blocks")

    def gather(batches):
        base = TaskContext.get().partitionId() << 32
        made = 0
        for batch in batches:
            texts, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in units(texts):
                yield pa.RecordBatch.from_pydict(
                    {"unit": [base + made], "keys": [[key128(t) for t in texts[a:b]]], "texts": [texts[a:b]], "blocks": [blocks[a:b]]}, schema=SCHEMA_UNITS
                )
                made += 1

    return joined.mapInArrow(gather, UNITS)


SCHEMA_KEYED = pa.schema([("key", pa.binary()), ("key64", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])
SCHEMA_UNITS = pa.schema(
    [("unit", pa.int64()), ("keys", pa.list_(pa.binary())), ("texts", pa.list_(pa.string())), ("blocks", pa.list_(pa.list_(pa.int32())))]
)
ASKED = "unit long, part int, f1 binary, f2 binary, twice binary"
SCHEMA_ASKED = pa.schema([("unit", pa.int64()), ("part", pa.int32()), ("f1", pa.binary()), ("f2", pa.binary()), ("twice", pa.binary())])


def removed(unit_rows: DataFrame, parts: int) -> DataFrame:
    """key128, n_removed, kept_sha256 of the texts in the units."""

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                f1, f2, _, _ = fingerprints(r["texts"], r["blocks"])
                order, new = distinct(f1, f2)
                twice = np.diff(np.append(new, len(order))) > 1
                a, b = f1[order][new], f2[order][new]
                which, at = ranges(a, 64, parts)
                rows = [
                    (r["unit"], p, deflate(a[i:j]), b[i:j].tobytes(), np.packbits(twice[i:j]).tobytes())
                    for p, i, j in zip(which.tolist(), at[:-1], at[1:], strict=True)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA_ASKED.types, strict=True)], schema=SCHEMA_ASKED)

    def answer(batches):
        for part, rows in by_part(batches):
            unit, f1, f2, flag = [], [], [], []
            for r in rows:
                unit.append(r["unit"])
                f1.append(inflate(r["f1"]))
                f2.append(np.frombuffer(r["f2"], np.uint32))
                flag.append(np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(f1[-1])).astype(bool))
            order, new = distinct(np.concatenate(f1), np.concatenate(f2))
            flags = np.concatenate(flag)[order]
            size = np.diff(np.append(new, len(order)))
            again = np.repeat((size > 1) | (np.add.reduceat(flags, new) > 0), size)
            back = np.empty(len(order), bool)
            back[order] = again
            ends = np.cumsum([len(f) for f in f1])
            bits = [np.packbits(x).tobytes() for x in np.split(back, ends[:-1])]
            yield pa.RecordBatch.from_pydict(
                {"unit": pa.array(unit, pa.int64()), "part": pa.array([part] * len(unit), pa.int32()), "n": pa.array([len(f) for f in f1], pa.int32()), "bits": bits}
            )

    asked = unit_rows.mapInArrow(ask, ASKED)
    answers = asked.repartition("part").sortWithinPartitions("part").mapInArrow(answer, "unit long, part int, n int, bits binary")
    of_unit = answers.groupBy("unit").agg(F.collect_list(F.struct("part", "n", "bits")).alias("answers"))

    def apply(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                texts = r["texts"]
                f1, f2, of, at = fingerprints(texts, r["blocks"])
                order, new = distinct(f1, f2)
                told = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]).astype(bool) for a in sorted(r["answers"] or [], key=lambda a: a["part"])]
                again = np.zeros(len(order), bool)
                if told:
                    again[order] = np.repeat(np.concatenate(told), np.diff(np.append(new, len(order))))
                out = {"key": r["keys"], "n_removed": [], "kept_sha256": []}
                edge = np.searchsorted(of, np.arange(len(texts) + 1))
                for k, t in enumerate(texts):
                    words = split(t)
                    runs = at[edge[k] : edge[k + 1]][again[edge[k] : edge[k + 1]]]
                    cover = np.zeros(len(words) + 1, np.int32)
                    np.add.at(cover, runs, 1)
                    np.add.at(cover, runs + WINDOW, -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    out["n_removed"].append(int(len(words) - keep.sum()))
                    out["kept_sha256"].append(sha(list(itertools.compress(words, keep.tolist()))))
                yield pa.RecordBatch.from_pydict(out, schema=SCHEMA_REMOVED)
        tidy()

    told = unit_rows.join(of_unit, "unit", "left").select("keys", "texts", "blocks", "answers")
    return told.mapInArrow(apply, "key binary, n_removed long, kept_sha256 string")


SCHEMA_REMOVED = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row.

    A window counts as repeated if its words also start anywhere else, in the same text, in
    another row, or in a row that repeats this one. Null and empty texts have no words; texts of
    fewer than 35 words lose none. Rows are told apart by their text, so null and repeated ids
    are as good as any. An empty table gives none; a long text is taken whole.
    """
    rows = pick(docs, "doc_id", "text")
    # ranges of hashes: in step with the input, so that one range fits a task
    parts = 256
    while parts < 2 * rows.rdd.getNumPartitions():
        parts *= 2

    def count(batches):
        base, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in pieces(batch, "text"):
                out = {"doc_id": part.column(0), "key": [], "key64": [], "n_words": [], "whole_sha256": []}
                for t in part.column(1).to_pylist():
                    words = split(t)
                    # a text too short to lose anything gets a key of its own, so such rows never gather
                    key = key128(t) if len(words) >= WINDOW else f"{base}:{made}".encode()
                    made += 1
                    out["key"].append(key)
                    out["key64"].append(key64(key))
                    out["n_words"].append(len(words))
                    out["whole_sha256"].append(sha(words))
                yield pa.RecordBatch.from_pydict(out, schema=SCHEMA_COUNTED)
        tidy()

    counted, _ = settle(rows.mapInArrow(count, "doc_id long, key binary, key64 long, n_words long, whole_sha256 string"))
    texts = counted.filter(F.col("n_words") >= WINDOW).groupBy("key", "key64").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
    hits, drop_hits = settle(hit_blocks(rows, parts))
    wanted, drop_wanted = settle(texts.join(hits.withColumnRenamed("key", "key64"), "key64").select("key", "key64", "doc_id", "blocks"))
    drop_hits()
    unit_rows, drop_units = settle(hit_units(rows, wanted))
    drop_wanted()
    lost = removed(unit_rows, parts).groupBy("key").agg(F.first("n_removed").alias("n_removed"), F.first("kept_sha256").alias("kept_sha256"))
    told = texts.select("key", "copies").join(lost, "key", "left").filter("copies > 1 OR n_removed > 0")
    told, _ = settle(told)
    drop_units()
    whole = F.col("copies") > 1
    return counted.join(told, "key", "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )


SCHEMA_COUNTED = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("key64", pa.int64()), ("n_words", pa.int64()), ("whole_sha256", pa.string())])
