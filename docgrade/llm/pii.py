"""PII by candidate gradient boosting: generous generators, boosted trees, calibrated thresholds.

Fixed rules give the base spans, which always stay. Generators of high recall propose further,
overlapping spans (any 7 to 15 digits with or without separators, national and bank numbers,
addresses spelt with "at" and "dot"); small boosted trees score each from its format and context;
per kind a threshold calibrated on examples that the trees never saw selects what is added.

No table marks personal data. The trees learn from candidates of the documents themselves: base
spans in their own surroundings, rewritten as the base rules would not see them (no plus, spelt
out), are personal; dates, version and order numbers and card numbers of a wrong checksum are not.
Kinds that documents rarely hold are made up by a seeded generator beside them.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, map_rows, named, pick, remember, sparing
from .toxicity import held_out

#: The base kinds in order, then those that only the method adds.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
BASE = KINDS[:4]

# A digit run's inner digits need no try of their own: what follows the run decides, so a match that
# fails at its first digit fails at every later one. Without that, long runs cost their square.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    """Around each @, the whole run of local characters before it and the domain after it."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


PHONES = (
    re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}(?![0-9A-Za-z])"),
    re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9](?:[()./-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"),
)
SSN = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4}(?![0-9A-Za-z-])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Za-z]{2}[0-9]{2}(?: ?[0-9A-Za-z]{4}){2,7}(?: ?[0-9A-Za-z]{1,3})?(?![0-9A-Za-z])")
AT = re.compile(r"[\[({] ?(?:at|AT) ?[\])}]")
SPELT = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[({] ?(?:at|AT) ?[\])}] ?[A-Za-z0-9-]{2,63}(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?|\.)[A-Za-z]{2,10}")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that might be personal data, overlapping as they come."""
    out = set()
    if ANY.search(text):
        for pattern in PHONES:
            out.update(("phone", m.start(), m.end()) for m in pattern.finditer(text))
        out.update(("ssn", m.start(), m.end()) for m in SSN.finditer(text))
        for m in IBAN.finditer(text):
            end = m.end()
            # words behind the number may have been taken for groups of it
            while not mod97(text[m.start() : end]) and (cut := text.rfind(" ", m.start() + 14, end)) > 0:
                end = cut
            out.add(("iban", m.start(), end if mod97(text[m.start() : end]) else m.end()))
    # the surroundings of each spelt-out at, a long local part whole; the pattern never runs over a whole long text
    free = 0
    for m in AT.finditer(text):
        a = m.start() - 1 if text[m.start() - 1 : m.start()] == " " else m.start()
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        if g := SPELT.match(text, a, m.end() + 80):
            out.add(("email", g.start(), g.end()))
        free = m.end()
    return sorted(out, key=lambda c: (c[1], c[2], c[0]))


#: Words near a candidate that speak for or against it.
FOR = re.compile(r"\b(?:tel|phone|call|mobile|fax|cell|contact|ssn|social|security|iban|account|bank|mail|email|e-mail|reach|write)\b", re.I)
AGAINST = re.compile(r"\b(?:version|v|order|invoice|isbn|page|pages|fig|figure|section|date|id|ref|no|lot|serial|part|issue|chapter|from|until|year|build)\b", re.I)
DATE = re.compile(r"(?:[12][0-9]{3}[ ./-][01]?[0-9][ ./-][0-3]?[0-9]|[0-3]?[0-9][ ./-][01]?[0-9][ ./-][12][0-9]{3}|[12][0-9]{3}[ /-][12][0-9]{3})$")


def mod97(s: str) -> bool:
    s = s.replace(" ", "")
    if len(s) < 15 or not s.isascii():
        return False
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of one candidate."""
    s, left, right = text[a:b], text[max(0, a - 32) : a], text[b : b + 16]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    return [
        float(KINDS.index(kind)),
        len(s),
        len(digits),
        len(groups),
        len(groups[0]) if groups else 0,
        len(groups[-1]) if groups else 0,
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        s.count("-"),
        s.count("."),
        s.count(" "),
        s.count("/"),
        float("(" in s),
        len(set(digits)),
        float(bool(FOR.search(left))),
        float(bool(AGAINST.search(left))),
        float(bool(DATE.match(s))),
        float(kind == "iban" and mod97(s)),
        float(kind == "ssn" and digits[:3] not in ("000", "666") and digits[:1] != "9" and digits[3:5] != "00" and digits[5:] != "0000"),
        float(right[:1] in ("%", "$", "€", ":")),
        float(bool(re.match(r"\s*(?:[A-Za-z]{1,3}\b|[x×*=+<>])", right)) and not FOR.search(left)),
        float(len(re.findall(r"[0-9]", left))),
    ]


@dataclass(frozen=True)
class Tree:
    """A tree of depth two in arrays: node 0 asks, nodes 1 and 2 ask, four leaves answer."""

    column: tuple[int, int, int]
    limit: tuple[float, float, float]
    leaf: tuple[float, float, float, float]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        right = x[:, self.column[0]] > self.limit[0]
        inner = np.where(right, x[:, self.column[2]] > self.limit[2], x[:, self.column[1]] > self.limit[1])
        return np.array(self.leaf)[2 * right + inner]


def split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float, float]:
    """Column, limit and gain of the best split of one node by second-order gain."""
    best = (0, np.inf, 0.0)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, gs, hs = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        gain = gs[cut] ** 2 / (hs[cut] + 1) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1) - whole
        k = int(np.argmax(gain))
        if gain[k] > best[2] + 1e-12:
            best = (j, float((v[cut[k]] + v[cut[k] + 1]) / 2), float(gain[k]))
    return best


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3) -> list[Tree]:
    z, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        c0, l0, _ = split(x, g, h)
        right = x[:, c0] > l0
        columns, limits, leaves = [c0], [l0], []
        for side in (~right, right):
            c, l, _ = split(x[side], g[side], h[side]) if side.any() else (0, np.inf, 0.0)
            columns.append(c)
            limits.append(l)
            for leaf in (side & (x[:, c] <= l), side & (x[:, c] > l)):
                leaves.append(float(rate * g[leaf].sum() / (h[leaf].sum() + 1)))
        trees.append(Tree(tuple(columns), tuple(limits), tuple(leaves)))
        z += trees[-1](x)
    return trees


def examples(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, personal) made up from formats and decoys; nothing in them is real."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeiourstnlmd") for _ in range(r.randint(2, 9)))

    def iban(good: bool) -> str:
        body = r.choice(["DE", "FR", "ES", "GB"])
        rest = d(r.choice([16, 18, 20]))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + body + "00")) % 97
        return body + f"{check if good else (check + r.randint(1, 90)) % 97:02d}" + rest

    yes = {
        "phone": lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(3)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"({d(3)}){d(3)}-{d(4)}", f"0{d(3)}-{d(7)}", d(10), f"0{d(10)}"]),
        "ssn": lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}".replace("-", r.choice(["-", "-", " ", ""])),
        "iban": lambda: r.choice([str, str.lower])(iban(True)),
        "email": lambda: f"{word()}{r.choice([' [at] ', '(at)', ' (at) '])}{word()}{r.choice([' [dot] ', '(dot)', '.'])}{r.choice(['com', 'org', 'net'])}",
    }
    no = {
        "phone": lambda: r.choice([f"20{d(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{d(2)}/{d(2)}/20{d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)}.{d(2)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"19{d(2)}-20{d(2)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}-{d(4)}-{d(4)}-{d(4)}", d(10), d(9), d(8), f"{d(1)}.{d(2)}.{d(4)}"]),
        "ssn": lambda: r.choice([f"000-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", f"{d(3)}-00-{d(4)}", f"666-{d(2)}-{d(4)}"]),
        "iban": lambda: r.choice([iban(False), "".join(r.choice("ABCDEFGH") for _ in range(2)) + d(2) + "".join(r.choice("ABCDEFGH0123456789") for _ in range(16))]),
        "email": lambda: f"{word()} (at) {word()}.{word()[:3] or 'xx'}ing",
    }
    out = []
    for i in range(n):
        kind, personal = r.choice(list(yes)), i % 2
        s = (yes if personal else no)[kind]()
        hints = {"phone": ["tel ", "phone: ", "call ", "mobile ", "fax "], "ssn": ["ssn ", "social security "], "iban": ["iban ", "bank ", ""], "email": ["mail ", "write ", ""]}
        hint = r.choice(hints[kind] + ([] if s.isdigit() else [""]) if personal else ["order ", "invoice no ", "version ", "from ", "id ", "", ""])
        left = " ".join(word() for _ in range(r.randint(0, 6))) + " "
        text = left + hint + s + " " + " ".join(word() for _ in range(r.randint(0, 4)))
        a = len(left) + len(hint)
        out.append((text, kind, a, a + len(s), personal))
    return out


@dataclass(frozen=True)
class Model:
    trees: tuple[Tree, ...]
    threshold: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-sum(t(x) for t in self.trees)))


def rewritten(text: str, kind: str, a: int, b: int) -> list[str]:
    """A base span as the base rules would not see it."""
    value = text[a:b]
    if kind == "phone":
        return [value[1:], value[1:].replace(" ", "-").replace("(", "").replace(")", "")]
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        return [f"{local} [at] {host} [dot] {top}", f"{local}(at){domain}"]
    return []


def told(text: str) -> list[tuple[list[float], int]]:
    """(features, personal) of those candidates of a document whose truth the base rules tell."""
    base, out = base_spans(text), []
    for kind, a, b in base:
        for value in rewritten(text, kind, a, b):
            left, right = text[max(0, a - 32) : a], text[b : b + 16]
            own = [c for c in candidates(left + value + right) if c[0] == kind and c[1] <= len(left) and c[2] >= len(left) + len(value)]
            out += [(features(left + value + right, *c), 1) for c in own]
    for kind, a, b in candidates(text):
        if any(x < b and a < y for _, x, y in base):
            continue
        value, left = text[a:b], text[max(0, a - 32) : a]
        digits = sum(c.isdigit() for c in value)
        decoy = DATE.match(value) or digits >= 12 or value.count(".") == 3 or AGAINST.search(left) or (value.isdigit() and not FOR.search(left))
        if kind in ("phone", "ssn") and decoy:
            out.append((features(text, kind, a, b), 0))
    return out


TOLD = "x array<double>, y int, fresh boolean, place long"


def document_examples(docs: DataFrame, most_docs: int, most_rows: int) -> list[tuple[list[float], int, bool]]:
    """(features, personal, kept for calibration): from at most so many documents and so many candidates."""
    rows = pick(docs, "doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]") & ~held_out(F.col("doc_id")))
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs).distinct()

    def step(cols: dict[str, list]) -> dict[str, list]:
        remember("pii", list)
        out: dict[str, list] = {"x": [], "y": [], "fresh": [], "place": []}
        for i, text in zip(cols["doc_id"], cols["text"], strict=True):
            for n, (x, y) in enumerate(told(text)):
                place = int.from_bytes(hashlib.blake2b(f"{i}:{n}".encode(), digest_size=7).digest(), "big")
                for k, v in (("x", x), ("y", y), ("fresh", i % 2 == 1), ("place", place)):
                    out[k].append(v)
        return out

    # at most most_docs numbers; at most most_rows of 22 numbers each come to the driver
    found = map_rows(rows.join(F.broadcast(ids), "doc_id"), step, TOLD)
    with sparing(docs.sparkSession):
        return sorted((list(r["x"]), r["y"], r["fresh"]) for r in found.orderBy("place", "x").limit(most_rows).collect())


def fit(docs: DataFrame | None = None, most_docs: int = 3000, most_rows: int = 20_000, made_up: int = 4000, precision: float = 0.995) -> Model:
    """Trees from half of the documents drawn by a hash of the id and from ``made_up`` examples; per
    kind the lowest threshold of that precision on the other half and as many others.

    A kind that never reaches it is never added. Held-out rows and null ids are left out.
    """
    rows = [] if docs is None else document_examples(docs, most_docs, most_rows)

    def table(seed: int, fresh: bool):
        made = [(features(*row[:4]), row[4]) for row in examples(made_up, seed)]
        both = made + [(x, y) for x, y, f in rows if f == fresh]
        return np.array([x for x, _ in both], float), np.array([y for _, y in both], float)

    trees = tuple(boost(*table(11, False)))
    x, truth = table(12, True)
    p = Model(trees, {}).score(x)
    limits = {}
    for k, kind in enumerate(KINDS):
        own = x[:, 0] == k
        if not own.any():
            continue
        order = np.argsort(-p[own], kind="stable")
        q = p[own][order]
        right = np.cumsum(truth[own][order]) / np.arange(1, own.sum() + 1)
        last = np.append(q[1:] < q[:-1], True)  # equal scores stand or fall together
        good = np.flatnonzero((right >= precision) & last)
        limits[kind] = float(q[good[-1]]) if len(good) else 2.0
    return Model(trees, limits)


@cache
def model() -> Model:
    """From made-up examples alone."""
    return fit()


class Taken:
    """Disjoint intervals in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Take the interval unless it overlaps."""
        i = bisect.bisect_left(self.ends, a + 1)
        if i < len(self.starts) and self.starts[i] < b:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def find(text: str | None, m: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: those and the method's own, which never overlap another.

    Of overlapping candidates the surer wins, then the longer, then the earlier.
    """
    text = text or ""
    base = base_spans(text) if ANY.search(text) else []
    found = candidates(text)
    if not found:
        return base, base
    taken = Taken([(a, b) for _, a, b in base])
    chosen = list(base)
    scored = []
    for i in range(0, len(found), 4096):
        part = found[i : i + 4096]
        p = m.score(np.array([features(text, *c) for c in part], float))
        scored += [(-q, c[1] - c[2], c[1], c) for c, q in zip(part, p.tolist(), strict=True) if q >= m.threshold.get(c[0], 2.0)]
    chosen += [c for *_, c in sorted(scored) if taken.add(c[1], c[2])]
    return base, sorted(chosen, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Each span becomes its kind in brackets; overlapping spans become one, named by the first."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < end:
            end = max(end, b)
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = end = b
    return "".join(out) + text[at:]


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, redacted string"
)


def scan(docs: DataFrame, m: Model | None = None, with_text: bool = False) -> DataFrame:
    """Counts, digest of the base spans, all spans; with the redacted text only where asked for.

    Without a model one is fitted on ``docs``. One pass without a shuffle. Null and empty texts have
    no spans, and a null stays null; repeated rows repeat; an empty table gives none; a long text is
    scanned whole, in time that grows as its candidates do.
    """
    m = fit(docs) if m is None else m

    def step(cols: dict[str, list]) -> dict[str, list]:
        remember("pii", list)
        out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
        for i, text in zip(cols["doc_id"], cols["text"], strict=True):
            base, every = find(text, m)
            out["doc_id"].append(i)
            for kind in BASE:
                out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(every))
            out["n_spans"].append(len(every))
            out["redacted"].append(redact(text, every) if with_text else None)
        return out

    got = map_rows(pick(docs, "doc_id", "text"), step, SCHEMA)
    return got if with_text else got.drop("redacted")


def redacted(docs: DataFrame, m: Model | None = None) -> DataFrame:
    """The same rows and columns, whatever their names, spans replaced in ``text``, ``n_chars`` counted anew.

    Null texts stay null with their n_chars; repeated rows repeat; an empty table stays one.
    """
    m = fit(docs) if m is None else m
    flat, at = by_place(docs)
    text = at["text"]

    def step(cols: dict[str, list]) -> dict[str, list]:
        remember("pii", list)
        return cols | {text: [redact(t, find(t, m)[1]) for t in cols[text]]}

    out = map_rows(flat, step, flat.schema, text)
    if "n_chars" in at:
        n = at["n_chars"]
        out = out.withColumn(n, F.coalesce(F.length(text).cast(flat.schema[n].dataType), F.col(n)))
    return named(out, docs.columns)
