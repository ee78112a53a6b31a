"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags by segment.

The template is data: for each role the segments of a turn, some of them the turn's own text, each
with its loss flag. The machine reads a conversation turn by turn. A transition names the next state
and what is emitted: the template's segments of the role. Orders that the machine does not know lead
to the state ``astray``, which takes every turn, so a broken conversation is formatted whole and
said to be broken. Texts are escaped so that no control string can arise inside one, and the escape
is undone exactly when the output is read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: state -> role -> next state; a conversation may end in any state of ENDS. Any other turn leads to ASTRAY.
STEPS = {
    "start": {"system": "told", "user": "asked"},
    "told": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
ENDS = {"answered"}
ASTRAY = "astray"

#: In a template's segments: the place of the turn's role and of its text.
ROLE, TEXT = "{role}", "{text}"


def turn(loss: bool) -> tuple[tuple[str, bool], ...]:
    """A turn's segments and their loss flags."""
    return (("<|im_start|>", False), (ROLE, False), ("\n", False), (TEXT, loss), ("<|im_end|>\n", False))


@dataclass(frozen=True)
class Template:
    """What a turn of each role emits; ``other`` serves roles that are not named."""

    turns: dict[str, tuple[tuple[str, bool], ...]] = field(default_factory=lambda: {"assistant": turn(True)})
    other: tuple[tuple[str, bool], ...] = turn(False)

    def escape(self, text: str) -> str:
        """``<|`` never stays as it is, so no control string survives; ``<\\`` is doubled to tell them apart."""
        return re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"<\\(\\*)\|", lambda m: "<" + m[1] + "|", text)

    def escape_role(self, role: str) -> str:
        """A role is one line: its line feeds are written out, and control strings escaped."""
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role))


class Machine:
    """Reads turns, emits segments; ``problem`` says where the order of roles was left, if it was."""

    def __init__(self, t: Template):
        self.t, self.state, self.n, self.problem = t, "start", 0, ""

    def step(self, role: str, text: str) -> Iterator[tuple[str, bool]]:
        """(text, carries loss) pieces of one turn, in order."""
        self.n += 1
        after = STEPS.get(self.state, {}).get(role, ASTRAY)
        if after == ASTRAY and not self.problem:
            self.problem = f"turn {self.n}: {role or 'no role'} after {self.state}"
        self.state = after
        for piece, loss in self.t.turns.get(role, self.t.other):
            yield (self.t.escape_role(role) if piece == ROLE else self.t.escape(text) if piece == TEXT else piece), loss

    def verdict(self) -> str:
        """'' for a valid conversation, else where and why it is not."""
        return self.problem or ("" if self.state in ENDS else f"ends {self.state}")


def check(roles: Iterable[str]) -> str:
    machine = Machine(Template())
    for role in roles:
        list(machine.step(role, ""))
    return machine.verdict()


OPEN, CLOSE = turn(False)[0][0], turn(False)[-1][0]


class Reader:
    """Reads formatted turns back as they come, from the text and its mask alone; holds one turn at a time."""

    def __init__(self, t: Template):
        self.t, self.head = t, ""
        self.turns, self.loss_chars, self.chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str, mask: list[tuple[int, int]]) -> None:
        """One whole turn and the spans of it under the mask."""
        t = self.t
        self.chars += len(formatted)
        if not formatted.startswith(OPEN) or not formatted.endswith(CLOSE):
            raise ValueError("not a turn")
        role, _, text = formatted[len(OPEN) : -len(CLOSE)].partition("\n")
        role, text = t.unescape_role(role), t.unescape(text)
        self.turns += 1
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for a, b in mask:
            under = t.unescape(formatted[a:b])
            self.loss_chars += len(under)
            self.loss.update(under.encode("utf-8", "surrogatepass"))


FORMATTED = "conv_id long, place long, segments array<struct<text:string,loss:boolean>>, problem string"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, problem string"


def in_order(rows: DataFrame) -> DataFrame:
    """Conversations whole in a partition, their turns in order: by turn (null first), then role, then text."""
    rows = pick(rows, "conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(rows: DataFrame, t: Template | None = None) -> DataFrame:
    """One row a turn: its place in the conversation, its segments with their loss flags, and what is wrong so far.

    The last turn's ``problem`` is the machine's verdict on the whole conversation, null for a valid
    one. A null text or role is the empty one. Rows of a null conv_id form one conversation, repeated
    rows are repeated turns, an empty table gives none. Turns are taken one by one, so the longest
    conversation needs no more memory than one turn; being one sequence, it is one task's work.
    """
    t = t or Template()

    def run(batches):
        now, machine = None, None
        for batch in batches:
            ids, places, made, problems = batch.column(0), [], [], []
            for conv, role, text in zip(ids.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now != (conv,):
                    now, machine = (conv,), Machine(t)
                made.append([{"text": s, "loss": f} for s, f in machine.step(role, text)])
                places.append(machine.n)
                problems.append(machine.verdict() or None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(places, pa.int64()), pa.array(made, pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), pa.array(problems, pa.string())],
                ["conv_id", "place", "segments", "problem"],
            )

    return in_order(rows).mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, t: Template | None = None) -> DataFrame:
    """One row a conversation from rows of ``format_turns`` in any order: what the output says.

    ``valid`` and ``problem`` are the machine's verdict; a conversation that breaks the order of
    roles is formatted all the same.
    """
    t = t or Template()

    def run(batches):
        now, reader, problem = None, None, None
        done: list[dict] = []

        def close():
            done.append(
                {
                    "conv_id": now[0],
                    "n_turns": reader.turns,
                    "turns_sha256": reader.all.hexdigest(),
                    "loss_chars": reader.loss_chars,
                    "loss_sha256": reader.loss.hexdigest(),
                    "formatted_chars": reader.chars,
                    "valid": problem is None,
                    "problem": problem,
                }
            )

        for batch in batches:
            for conv, segs, said in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now != (conv,):
                    if now is not None:
                        close()
                    now, reader = (conv,), Reader(t)
                problem, text, mask = said, [], []
                at = 0
                for s in segs:
                    if s["loss"]:
                        mask.append((at, at + len(s["text"])))
                    text.append(s["text"])
                    at += len(s["text"])
                reader.feed("".join(text), mask)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema=ARROW)
                done.clear()
        if now is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=ARROW)

    ordered = pick(formatted, "conv_id", "place", "segments", "problem").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(run, READ)


ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
        ("valid", pa.bool_()),
        ("problem", pa.string()),
    ]
)
