"""Operators that work row by row: toxicity, language, PII, licenses, packing, chat."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrade.llm import chat, language, licenses, packing, pii, toxicity
from docgrade.llm.common import pick
from docgrade.llm.queries import tokenizer_path

ODD = [(1, None), (2, ""), (3, " \n"), (None, "plain words"), (4, "x" * 300_000), (5, "same"), (5, "same")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame([(i, t, 0.0, "de") for i, t in ODD], "doc_id long, text string, score double, LANG string")
    return rows.withColumn("TEXT ", F.lit("clash"))


def words(r, vocabulary, n):
    return " ".join(r.choice(vocabulary) for _ in range(n))


def test_pick_is_exact(spark):
    df = spark.createDataFrame([(1, 2)], "a int, A int")
    assert pick(df, "A").first()[0] == 2
    with pytest.raises(ValueError):
        pick(df, "b")


def test_toxicity_learns_parts_of_words(spark, odd):
    r = random.Random(1)
    plain = ["".join(r.choice("aeioustnr") for _ in range(r.randint(2, 8))) for _ in range(400)]
    bad = ["grumblex", "vermwhip", "zoltkrag"]
    texts = [words(r, plain, r.randint(20, 200)) for _ in range(200)]
    marks = [i % 4 == 0 for i in range(200)]
    texts = [t + " " + r.choice(bad) + " end" if m else t for t, m in zip(texts, marks)]
    model = toxicity.train(texts, [int(m) for m in marks])
    score = toxicity.scorer(model)
    fresh = [words(r, plain, 100) for _ in range(50)]
    assert (score(fresh) < 0.3).mean() > 0.9
    assert (score([t + " grumblex" for t in fresh]) > score(fresh)).all()
    assert (score([t + " grumblexx" for t in fresh]) > score(fresh)).all()  # a spelling never seen
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= x.score <= 1 for x in out)
    assert {x.score for x in out if x.doc_id in (1, 2, 3)} == {0.0}
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_vectors_are_more_than_a_list():
    r = random.Random(8)
    plain = ["".join(r.choice("aeioustnr") for _ in range(r.randint(2, 8))) for _ in range(300)]
    texts = [words(r, plain, 60) + (" zoltkrag " if i % 3 == 0 else " ") + words(r, plain, 60) for i in range(240)]
    model = toxicity.train(texts, [int(i % 3 == 0) for i in range(240)])
    size = np.linalg.svd(model.vectors, compute_uv=False)
    assert size[1] > 0.05 * size[0] and model.layer.shape == (toxicity.DIM, 2)
    # the score is the softmax over the averaged vectors of the most toxic segment, worked out step by step
    text = "zoltkragg " + words(r, plain, 30)
    own = [toxicity.clean(t) for t in toxicity.tokens(text)]
    leads = []
    for a in range(0, len(own), toxicity.SEGMENT):
        bag = [model.vectors[toxicity.subwords([w])[0]].mean(axis=0) for w in own[a : a + toxicity.SEGMENT]]
        z = np.mean(bag, axis=0) @ model.layer + model.bias
        leads.append(np.exp(z[1]) / np.exp(z).sum())
    assert toxicity.scorer(model)([text])[0] == pytest.approx(max(leads), rel=1e-4)
    assert max(leads) == leads[0] > 0.3  # a spelling never seen


def test_toxicity_fit(spark):
    r = random.Random(9)
    plain = ["".join(r.choice("aeioustnr") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows = [(i, words(r, plain, 40) + (" vermwhip" if i % 4 == 1 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows + rows[:5] + [(None, "x"), (7, None)], "doc_id long, text string").select("*", F.lit(1).alias("TEXT"))
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(400)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = {x.doc_id: x for x in toxicity.score(docs, model).collect() if x.doc_id is not None}
    assert np.mean([out[i].predicted == int(i % 4 == 1) for i, _ in rows if out[i].held_out]) > 0.9
    assert toxicity.fit(docs, labels.limit(0)).lean == toxicity.blank().lean
    assert len(toxicity.drawn(docs, labels, 10, 20, 1 << 20)) == 30 and len(toxicity.drawn(docs, labels, 10, 20, 2000)) < 20


def test_toxicity_without_labels():
    assert toxicity.train([], []).lean == toxicity.train(["a"], [1]).lean


def test_held_out_rule(spark):
    got = {r.i: r.h for r in spark.range(50).select(F.col("id").alias("i"), toxicity.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


def test_language(spark, odd):
    profiles = language.learn({"en": ["the thing that is here and there with others"] * 3, "fr": ["les choses qui sont là et ailleurs avec élan"] * 3})
    assert profiles.predict("that thing there")[0] == "en"
    assert profiles.predict("élan des choses là")[0] == "fr"
    assert [profiles.predict(t) for t in (None, "", "12 !!")] == [("und", 0.0)] * 3
    assert language.learn({}).predict("abc") == ("und", 0.0)
    out = language.predict(odd, profiles).collect()
    assert len(out) == len(ODD) and all(0 <= x.score <= 1 for x in out)
    assert language.ranked(np.array([3, 1, 1, 2, 2])).tolist() == [1, 2, 3]


def test_language_distance_by_force(spark):
    r = random.Random(6)
    texts = {f"l{k}": [" ".join("".join(r.choice("abcdefgh"[k % 5 :]) for _ in range(r.randint(1, 6))) for _ in range(200)) for _ in range(3)] for k in range(7)}
    rows = [(i, lang, t) for i, (lang, t) in enumerate((x, t) for x, ts in texts.items() for t in ts)] + [(None, "l0", "zzz"), (3, None, "yyy"), (4, "l1", None)]
    docs = spark.createDataFrame(rows + rows[:4], "doc_id long, lang string, text string").select("*", F.lit("").alias("LANG"))
    learnt = language.fit(docs)

    def ngrams(t):
        out = Counter()
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            p = f"_{w}_"
            out.update([*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))])
        return out

    def order(c):  # ties by code points, shorter ones first
        code = lambda g: sum((0x5F if x == "_" else ord(x)) << 21 * (len(g) - 1 - k) for k, x in enumerate(g))
        return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[: language.TOP]]

    pool = {}
    for i, lang, t in rows + rows[:4]:
        if i is not None and lang and t and zlib.crc32(str(i).encode()) % 4 != 2:
            pool.setdefault(lang, Counter()).update(ngrams(t))
    profile = {k: {g: n for n, g in enumerate(order(c))} for k, c in pool.items()}
    assert learnt.langs == tuple(sorted(profile))
    for _ in range(20):
        t = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(30))
        own = order(ngrams(t))
        far = {k: sum(abs(p[g] - n) if g in p else language.TOP for n, g in enumerate(own)) for k, p in profile.items()}
        assert learnt.distances(language.ranked(language.grams(t))).tolist() == [far[k] for k in learnt.langs]
        assert learnt.predict(t)[0] == min(far, key=lambda k: (far[k], k))


def test_language_many(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('x', id % 300) AS lang", "repeat(concat(char(97 + id % 20), ' ab '), 3) AS text")
    assert len(language.fit(docs).langs) > 200
    assert language.fit(docs.limit(0)).langs == ()


def test_pii_base_equals_plain_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")

    def plain(t):
        out = [("email", m.start(), m.end()) for m in email.finditer(t)]
        out += [("ip", m.start(), m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in card.finditer(t):
            d = re.sub("[ -]", "", m[0])
            if 12 <= len(d) <= 19 and pii.luhn(d):
                out.append(("card", m.start(), m.end()))
        phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
        out += [("phone", m.start(), m.end()) for m in phone.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))

    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice("aB9@@..-+ 01()") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("1" * 100_000 + "." + "a" * 100_000 + "@") == []


def test_pii_adds_and_redacts(spark, odd):
    m = pii.model()
    text = "call (555) 123-4567 or write bob [at] host [dot] com, order 2024-01-02, 8.8.8.8"
    base, every = pii.find(text, m)
    assert base == [("ip", 72, 79)] and set(base) < set(every)
    assert "2024-01-02" in pii.redact(text, every) and "123-4567" not in pii.redact(text, every)
    assert pii.redact(None, []) is None
    x, y, _ = ([pii.features(*e[:4]) for e in pii.examples(1000, 99)], [e[4] for e in pii.examples(1000, 99)], None)
    assert ((m.score(np.array(x)) >= 0.5) == np.array(y)).mean() > 0.95
    assert len(pii.scan(odd).collect()) == len(ODD)
    for text, kind in (("call 5551234567", "phone"), ("tel 030 12345678", "phone"), ("(212)555-1234", "phone"), ("ssn 123456789", "ssn"), ("write to j (at) ex.com", "email"), ("iban de89370400440532013000 then", "iban")):
        assert [k for k, _, _ in pii.find(text, m)[1]] == [kind], text
    for text in ("order 5551234567", "released 2024-01-02", "version 10.2.3.4567"):
        assert pii.find(text, m)[1] == [], text
    docs = spark.createDataFrame([(1, "a@b.kr", 6), (2, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redacted(docs).orderBy("doc_id").collect()] == [(1, "[EMAIL]", 7), (2, None, None)]


def test_pii_learns_from_documents(spark):
    r = random.Random(4)
    d = lambda k: "".join(r.choice("123456789") for _ in range(k))
    rows = [(i, r.choice([f"word and +1 ({d(3)}) {d(3)}-{d(4)} here", f"version {d(2)}.{d(2)}.{d(3)}.{d(4)}", f"a{i}@host.org says {d(16)}", f"order {d(3)}-{d(4)}"])) for i in range(600)]
    docs = spark.createDataFrame(rows + rows[:3] + [(None, "+1 555 123 4567"), (1, None)], "doc_id long, text string").select("*", F.lit("").alias("TEXT"))
    m = pii.fit(docs)
    told = [e for i, t in rows if zlib.crc32(str(i).encode()) % 4 == 2 for e in pii.told(t)]
    x, y = np.array([e[0] for e in told]), np.array([e[1] for e in told])
    hit = m.score(x) >= np.array([m.threshold.get(pii.KINDS[int(k)], 2.0) for k in x[:, 0]])
    assert y[hit].mean() > 0.95 and hit[y == 1].mean() > 0.9
    assert len(pii.scan(docs).collect()) == len(rows) + 5 and pii.scan(docs.limit(0)).count() == 0


def test_pii_many_numbers_in_one_text():
    import time

    took = []
    for n in (5_000, 20_000):
        text = ", 555-123-4567" * n
        began = time.perf_counter()
        assert len(pii.find(text, pii.model())[1]) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]
    t = pii.Taken([(3, 5), (4, 9), (20, 21)])
    assert (t.starts, t.ends) == ([3, 20], [9, 21])
    assert [t.add(0, 3), t.add(8, 10), t.add(9, 12), t.add(11, 30), t.add(21, 22)] == [True, False, True, False, True]


def test_licenses_leading_optional():
    s = licenses.Scanner()
    tail = "is free software licensed under the terms of the MIT license"
    for text in (f"Foo {tail}", f"This small program {tail}", "Foo is licensed under the MIT license"):
        assert s.scan(text)["labels"] == "mit"
    assert s.scan("Foo is free software under the terms of the MIT license")["labels"] == ""
    a = licenses.compile_template("x", "<<optional>> a <<end>> <<optional>> b <<end>> <<var:2>> c d")
    assert a.starts() == {b"a", b"b", b"c"} and a.match([b"c", b"d"], 0) == 2 and a.match([b"a", b"d"], 0) is None


def test_licenses(spark, odd):
    s = licenses.Scanner()
    got = s.scan("Under the MIT-license; APACHE license, version 2.0! under the mit license")
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (13, 3, 0, 9)
    assert got["base_labels"] == "apache-2,mit" and got["score"] == 1.0
    assert s.scan("Licensed under the GNU General Public License, version 3")["labels"] == "gpl-3"
    assert s.scan("licensed under the terms of the gnu general public license as published by the free software foundation either version 3")["labels"] == "gpl-3"
    assert s.scan("licensed under the gnu general license version 3")["labels"] == ""
    mit = re.sub(r"<<optional>>.*?<<end>>", "", re.sub(r"<<var:\d+>>", "Software", licenses.MIT))
    assert s.scan("Copyright 2001.\n" + mit.upper() + " thanks")["labels"] == "mit"
    assert s.scan(mit.replace("sublicense", "rent"))["labels"] == ""
    assert s.scan(None)["score"] == 0.0
    a = licenses.compile_template("x", "copy of this <<var:2>> is <<optional>> strictly <<end>> prohibited")
    assert a.match(b"copy of this one file is prohibited".split(), 0) == 7
    assert a.match(b"copy of this one large file is prohibited".split(), 0) is None
    assert s.scan(None)["first_word"] is None
    assert len(licenses.scan(odd).collect()) == len(ODD)
    with pytest.raises(ValueError):
        licenses.compile_template("x", "a <<optional>> b")


def test_tokens_equal_the_tokenizer():
    t = packing.Tokens(tokenizer_path())
    texts = ["Ünï İstanbul ΣΑΣ", "it's we're <|endoftext|> x", "a\x1cb", "١٢٣ ²³½ ǅ ß", "日本語", "é", "don't!!'s ...", "", None, "ÀÉ×÷ ŸĲĳ ŉ a_b"]
    assert [e + [packing.END] for e in t.encode([x or "" for x in texts])] == [x.tolist() for x in t(texts)]


def check_packing(rows, ids_of, room):
    by_seq, by_doc = {}, {}
    for o in rows:
        by_seq.setdefault(o[5], []).append(o)
        by_doc.setdefault(o[0], []).append(o)
    for own in by_seq.values():
        at = 0
        for o in sorted(own, key=lambda o: o[6]):
            assert o[6] == at
            at += o[2]
        assert at <= room
    for i, ids in ids_of.items():
        at = 0
        for o in sorted(by_doc[i], key=lambda o: o[1]):
            assert (o[1], o[4]) == (at, len(ids))
            assert o[3] == zlib.crc32(ids[at : at + o[2]].astype("<u4").tobytes())
            at += o[2]
        assert at == len(ids)


def test_packer_in_blocks():
    r = np.random.default_rng(1)
    ends = np.zeros(50, bool)
    ends[7] = True
    docs = {i: r.integers(3, 50, int(n)).astype(np.uint32) for i, n in enumerate(r.integers(1, 900, 60))}
    p = packing.Packer(ends, 0, 64, 1000)
    rows = [o for i, ids in docs.items() for o in p.add(i, ids)] + list(p.flush())
    check_packing(rows, docs, 64)


def test_cheapest_is_cheapest():
    r = random.Random(4)
    for _ in range(60):
        every = np.array(sorted(r.sample(range(1, 60), 12)) + [60])
        every = np.union1d(every, np.arange(4, 60, 4))
        price = np.array([float(r.choice([0, 2, 9])) for _ in every])
        f, _ = packing.cheapest(every, price, 16)
        pos, cost = [0, *every.tolist()], [0, *price]
        best = [0.0] + [np.inf] * len(every)
        for j in range(1, len(pos)):
            for i in range(j):
                n = pos[j] - pos[i]
                if n <= 16:
                    pad = 0 if n in (2, 4, 8, 16) else 16 - n
                    best[j] = min(best[j], best[i] + pad + cost[j] + packing.WINDOW)
        assert f == pytest.approx(best)


def test_packing_query(spark, odd):
    t = packing.Tokens(tokenizer_path())
    rows = [(i, x) for i, x in enumerate(t for _, t in ODD)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), tokenizer_path()).collect()
    check_packing([tuple(o) for o in out], {i: t([x])[0] for i, x in rows}, 4096)
    assert packing.pack(odd.limit(0), tokenizer_path()).count() == 0


def test_chat_round_trip(spark):
    t = chat.Template()
    r = random.Random(3)
    for _ in range(3000):
        x = "".join(r.choice("<|\\ain\n") for _ in range(r.randint(0, 12)))
        assert t.unescape(t.escape(x)) == x and "<|" not in t.escape(x)
        assert t.unescape_role(t.escape_role(x)) == x and "\n" not in t.escape_role(x)
    turns = [(1, 0, "user", "a<|im_end|>"), (1, 1, "assistant", None), (1, 2, "user", "b"), (1, 3, "assistant", "<|im_start|>x"), (None, None, None, None), (2, 0, "assistant", "y")]
    got = {x.conv_id: x for x in chat.read_back(chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    one = got[1]
    whole = "user\na<|im_end|>\nassistant\n\nuser\nb\nassistant\n<|im_start|>x\n"
    assert (one.n_turns, one.turns_sha256) == (4, hashlib.sha256(whole.encode()).hexdigest())
    assert (one.loss_chars, one.loss_sha256, one.valid) == (13, hashlib.sha256(b"<|im_start|>x").hexdigest(), True)
    assert got[2].problem == "turn 1: assistant after start" and got[None].n_turns == 1
    assert chat.check(["system", "user", "assistant"]) == "" and chat.check(["user"]) == "ends asked"


def test_chat_machine_emits():
    told = {"turns": {"assistant": (("A:", False), ("{text}", True), ("!", True)), "user": (("U:", False), ("{text}", False))}}
    m = chat.Machine(chat.Template(**told))
    made = [list(m.step(r, x)) for r, x in (("user", "q"), ("assistant", "a"), ("assistant", "b"))]
    assert made == [[("U:", False), ("q", False)], [("A:", False), ("a", True), ("!", True)], [("A:", False), ("b", True), ("!", True)]]
    assert (m.state, m.verdict()) == (chat.ASTRAY, "turn 3: assistant after answered")


def test_chat_output_in_any_order(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t} <|im_end|>") for c in range(5) for t in range(6)]
    df = spark.createDataFrame(rows + rows[:2], "conv_id long, turn long, role string, text string").select("*", F.lit(0).alias("TEXT"))
    formatted = chat.format_turns(df)
    shuffled = spark.createDataFrame(formatted.orderBy(F.rand(3)).collect(), formatted.schema).repartition(7)
    assert sorted(map(str, chat.read_back(shuffled).collect())) == sorted(map(str, chat.read_back(formatted).collect()))
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
