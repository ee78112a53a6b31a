"""Operators that compare rows with rows, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrade.llm import decontamination, nearcopies, substrings, topk
from docgrade.llm.wordhash import windows


def test_windows():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 100).astype(np.uint64)
    for size in (1, 2, 3, 4, 7, 18, 35):
        a, b = windows(base, size), windows(base[10:60], size)
        assert len(set(a.tolist())) == len(a) == 101 - size and (b == a[10 : 61 - size]).all()
    assert len(windows(base, 101)) == 0


@pytest.mark.parametrize("dim", [1, 5, 64])
def test_topk(spark, dim):
    r = random.Random(dim)
    rows = [(i, [r.uniform(-1, 1) * r.random() for _ in range(dim)]) for i in range(300)]
    # one vector under many ids, one id with many vectors, repeated queries
    rows += [(i, rows[7][1]) for i in range(300, 320)] + [(5, rows[k][1]) for k in range(10)] + [rows[0], rows[0], rows[50]]
    odd = [(400, None), (400, [None] * dim), (450, [float("nan")] * dim), (450, [float("inf")] * dim), (None, rows[0][1]), (404, [1.0] * (dim + 1))]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = sorted(tuple(x) for x in topk.topk(df.select("*", F.lit(1).alias("VEC_ID")), F.col("vec_id") % 50 == 0, 5).collect())
    v = [(i, np.floor(256 * np.array(np.array(x, np.float32), float)).astype(int)) for i, x in rows]
    want = []
    for a, (q, x) in enumerate(v):
        if q % 50 == 0:
            order = sorted((-int(y @ x), i) for b, (i, y) in enumerate(v) if a != b)[:5]
            want += [(q, n + 1, i, -score) for n, (score, i) in enumerate(order)]
    assert got == sorted(want)
    assert topk.topk(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_topk_few_rows(spark):
    df = spark.createDataFrame([(50, [1.0]), (50, [1.0]), (1, [0.5]), (1, [0.5]), (2, [3.0])], "vec_id long, embedding array<double>")
    assert len(topk.topk(df, F.col("vec_id") % 50 == 0, 5).collect()) == 8


def components_by_force(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                    up[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def test_near_copies(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([3, 5, 8, 20, 60, 150]))] for _ in range(25)]
    rows = []
    for i in range(300):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    hub = [r.choice(vocabulary) for _ in range(150)]  # a large group, many of whose members lie apart
    for i in range(300, 420):
        w = list(hub)
        for _ in range(r.randrange(12)):
            w[r.randrange(150)] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "a"), (903, "A"), (904, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(x) for x in nearcopies.groups(df, size=4).collect()) == components_by_force(rows, 4)


def test_near_copies_edges(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A b c d e")]
    got = {(x.doc_id, x.component_id, x.kept) for x in nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, None, True)}
    assert nearcopies.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_of_few():
    s = nearcopies.shingles("one", 5)
    assert len(nearcopies.signature(s)) == nearcopies.BINS and len(nearcopies.bands(nearcopies.signature(s))) == nearcopies.BANDS


def removed_by_force(rows):
    count = Counter()
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in split:
        count.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    out = []
    for i, w in split:
        cover = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                cover[k : k + 35] = [True] * 35
        kept = [x for x, c in zip(w, cover) if not c]
        out.append((i, len(w), sum(cover), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(50)]
    source = [" ".join(r.choice(vocabulary) for _ in range(200)).split() for _ in range(5)]
    rows = []
    for i in range(60):
        a, b, x, y = r.choice(source), r.choice(source), r.randrange(150), r.randrange(150)
        noise = [r.choice(vocabulary) for _ in range(r.randrange(20))]
        rows.append((i, " ".join(noise + a[x : x + r.randrange(30, 60)] + noise[:3] + b[y : y + r.randrange(30, 60)])))
    rows += [(500, None), (501, ""), (None, rows[3][1]), (502, " ".join(["a"] * 80)), (503, " ".join(["b"] * 35)), (504, " ".join(["c"] * 36)), (505, rows[4][1]), (505, rows[4][1])]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((tuple(x) for x in got), key=repr) == removed_by_force(rows)


def test_planes_round_trip():
    v = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    assert (substrings.inflate(substrings.deflate(v)) == v).all()
    assert len(substrings.inflate(substrings.deflate(v[:0]))) == 0


def test_decontamination(spark):
    items = [
        (1, "In the market Tom bought 12 apples for 5 dollars and then Tom ate 3 of them quickly"),
        (2, "short one"),
        (3, None),
        (4, "The quick fox jumps over lazy dogs near the old river bank today"),
    ]
    docs = [
        (1, "Some intro. In the market Ann bought 7 apples for 9 dollars and then Ann ate 4 of them quickly. end"),
        (2, "In the market Ann bought 7 apples for 9 dollars while Bob cooked a very large meal for them slowly"),
        (3, None),
        (4, ""),
        (5, "xx the quick fox jumps over lazy dogs near the old river bank today yy"),
        (6, "nothing here to see at all folks just text and more"),
        (7, "a short one"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(d, b).collect()}
    assert got == {(1, 1), (5, 4)}
    assert sorted(x.doc_id for x in decontamination.clean(d, b).collect()) == [2, 3, 4, 6, 7]
    assert decontamination.contaminated(d.limit(0), b).count() == 0
    assert decontamination.clean(d, b.limit(0)).count() == len(docs)


def leaked(spark, items, docs):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(x.doc_id, x.item_id) for x in decontamination.contaminated(d, b).collect()}


def test_decontamination_moved_words(spark):
    item = "every morning old Tom bakes fresh bread rolls and then he gave 12 loaves to his neighbours who live across the long quiet street near the river for only $12 each week"
    docs = [
        item,
        item.replace("gave 12 loaves", "gave away 12 loaves"),
        item.replace("Tom", "Mary Ann"),
        item.replace("$12", "12 dollars"),
        item.replace("loaves to his", "loaves right away to his").replace("quiet street", "street"),
        "every morning old Tom bakes fresh bread rolls and then nothing else was done by anyone at all in the town that whole week or after",
    ]
    assert leaked(spark, [item], docs) == {(i, 0) for i in range(5)}
    # names without end take no stack
    assert leaked(spark, [item], ["met " + "Tom Ann " * 30_000 + "1,2," * 30_000 + item]) == {(0, 0)}


def test_decontamination_at_every_offset(spark):
    item = "we keep seven small boats quietly behind an old barn close by water"
    texts = [item, item.replace("behind an", "before one")]
    docs = [" ".join(["aa", "bb", "cc"][:n] + [text, "dd"]) for text in texts for n in range(4)]
    assert leaked(spark, [item], docs) == {(i, 0) for i in range(8)}


def test_decontamination_opening_names(spark):
    item = "Tom has 12 apples. Sara gives him 5. Tom eats 3. How many remain?"
    told = item.replace("Tom", "Ann").replace("Sara", "Mia").replace("12", "20")
    docs = [pre + told for pre in ("", "so ", "so it ", "so it goes: ", "(", "one line\n", "\u201c")]
    docs += [item.lower(), "Tom has 12 apples. Nothing else is told here. They went home and many years went by."]
    assert leaked(spark, [item], docs) == {(i, 0) for i in range(8)}


def test_decontamination_runs_of_six_and_lists(spark):
    item = "Each morning the baker carries warm bread past the old stone bridge while children wait beside a quiet river"
    words = item.split()
    for at in range(4):  # wherever the text stands, six equal words in a row are met
        text = " ".join(["filler"] * at + words[:6] + ["other"] + words[7:13] + ["other"] + words[14:])
        found = decontamination.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
        assert [(x.doc_id, x.item_id) for x in found.collect()] == [(1, 9)]
    numbers = " ".join(f"{i}, {i + 1};" for i in range(200))
    docs = spark.createDataFrame([(1, numbers), (2, "Anna, Maria, Paul, Peter, Clara, Hugo, Emma, Felix came by")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Add 3, 4, 5, 6, 7, 8 and 9 to 12, then say what is left of 40"), (2, "Otto, Ida, Karl, Lena, Max, Nora, Tim, Vera")], "item_id long, text string")
    assert decontamination.contaminated(docs, items).count() == 0


def test_decontamination_short_and_unspaced(spark):
    capital, chinese = "What is the capital city of France?", "\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u54ea\u4e00\u5ea7\u57ce\u5e02\u5462"
    items = [capital, chinese, "short one", "Ann Mary Tom Sara Mia Bob Joe Sue"]
    docs = [
        f"He asked: {capital} Nobody knew.",
        capital.replace("France", "Spain"),
        f"\u4ed6\u95ee{chinese}\u6211",
        "a short one",
        "Short one!",
        f"with {items[3]} again",
        capital.lower() + " " + capital,
    ]
    assert leaked(spark, items, docs) == {(0, 0), (2, 1), (4, 2), (5, 3), (6, 0)}


def test_pipeline(spark):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    sf_dir = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns
        kept.append((name, docs.count()))
    assert kept[0][1] >= kept[1][1] >= kept[2][1] == kept[3][1] > 0
    groups = defaultdict(set)
    for x in corpus_pipeline.run(spark, sf_dir).collect():
        groups[x.doc_id].add(x.start)
    assert len(groups) == kept[3][1]
