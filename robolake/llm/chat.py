"""Chat formatting: a finite-state machine over roles checks the order of turns, a declarative template writes the segments.

Each segment of the output has its text and whether it bears loss. Control strings inside texts, and the escape sign
itself, get the escape sign before them, so the formatted text can be parsed back exactly.
Turns of a conversation are streamed in order: they are dealt by conv_id and sorted, and a task keeps the state of one conversation only,
so a conversation may have any number of turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, table_at

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands before and behind a text of each role, which roles bear loss, and which role may follow which.

    ``other`` serves roles that the template doesn't name; the role is written, escaped, between its first two strings.
    No control string may hold the escape sign or end as another begins.
    """

    roles: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    loss: frozenset[str]
    follows: dict[str, frozenset[str]]
    #: Inner strings that are control strings as well.
    controls: tuple[str, ...] = field(default=())

    def pattern(self) -> re.Pattern:
        marks = {m for pair in self.roles.values() for m in pair} | {*self.other, *self.controls}
        return re.compile("|".join(re.escape(m) for m in sorted(marks | {ESCAPE}, key=lambda m: (-len(m), m))))


#: State "" is the beginning.
INSTRUCT = Template(
    roles={"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")},
    other=("[ROLE]", "[/ROLE]", "[/TURN]"),
    loss=frozenset({"assistant"}),
    follows={
        "": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"}),
    },
    controls=("<s>",),
)


class Machine:
    """Walks over the roles of one conversation; problem names the first turn out of order."""

    def __init__(self, template: Template):
        self.template, self.state, self.turn, self.problem = template, "", 0, None

    def step(self, role: str) -> None:
        if self.problem is None and role not in self.template.follows.get(self.state, ()):
            self.problem = f"turn {self.turn}: {role or 'no role'} after {self.state or 'the beginning'}"
        self.state, self.turn = role, self.turn + 1

    def end(self) -> str | None:
        return self.problem if self.problem or self.state in self.template.loss else f"ends after {self.state or 'the beginning'}"


def escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: ESCAPE + m[0], text)


_escaped = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def segments(role: str, text: str, template: Template, pattern: re.Pattern) -> list[tuple[str, bool]]:
    body = escape(text, pattern)
    if role in template.roles:
        before, behind = template.roles[role]
        return [(before, False), (body, role in template.loss), (behind, False)]
    a, b, c = template.other
    return [(a + escape(role, pattern) + b, False), (body, False), (c, False)]


def parse(text: str, template: Template, pattern: re.Pattern) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    marks: list[tuple[str, int, int]] = []
    at = 0
    while m := pattern.search(text, at):
        if m[0] == ESCAPE:
            at = m.end() + 1
        else:
            marks.append((m[0], m.start(), m.end()))
            at = m.end()
    out, k = [], 0
    opening = {a: role for role, (a, _) in template.roles.items()}
    while k < len(marks):
        if marks[k][0] == template.other[0]:
            out.append((unescape(text[marks[k][2] : marks[k + 1][1]]), unescape(text[marks[k + 1][2] : marks[k + 2][1]])))
            k += 3
        else:
            out.append((opening[marks[k][0]], unescape(text[marks[k][2] : marks[k + 1][1]])))
            k += 2
    return out


SEGMENTS = "conv_id long, turn long, seq long, segments array<struct<text:string,loss:boolean>>, problem string"


def _in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(keys[0]).sortWithinPartitions(*keys)


def format_chats(turns: DataFrame, template: Template = INSTRUCT, path: str | None = None) -> DataFrame:
    """Write the segments of every turn (SEGMENTS; problem in a conversation's last row) at path, or if none is given in the shared
    folder until the application ends; gives the written table.

    Null text and null role are empty; a role that the template doesn't name is written as ``other`` and never bears loss; turns of
    equal number stand in the order of role and text; repeated rows are turns of their own; a null conv_id is a conversation.
    Conversations in a wrong order are formatted all the same and say so in problem. Other columns aren't read.
    """
    bounded_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = template.pattern()
        machine, held, seq = Machine(template), None, 0
        names = [f.split()[0] for f in SEGMENTS.split(", ")]
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows, strict=True))
            parts = pa.array([[{"text": t, "loss": s} for t, s in x] for x in c[3]], kind)
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:3]), parts, pa.array(c[4], pa.string())], names)

        for b in batches:
            rows = []
            for conv, turn, role, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if held and held[0] != conv:
                    rows.append((*held, machine.end()))
                    machine, held, seq = Machine(template), None, 0
                if held:
                    rows.append((*held, None))
                machine.step(role)
                held = (conv, turn, seq, segments(role, text, template, pattern))
                seq += 1
            if rows:
                yield batch(rows)
        if held:
            yield batch([(*held, machine.end())])

    said = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *said)
    ordered = _in_order(rows, ["conv_id", "turn", "role", "text"])
    return table_at(ordered.mapInArrow(run, SEGMENTS), path or scratch(turns.sparkSession, "chats"))


def read_chats(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What the written conversations hold, parsed from their text: counts and digests for each."""
    bounded_batches(formatted.sparkSession)
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, valid boolean, problem string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = template.pattern()
        names = [f.split()[0] for f in schema.split(", ")]
        key, state = None, None

        def fresh() -> dict:
            return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "problem": None}

        def row(key, s) -> tuple:
            digests = s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest()
            return (key, s["n"], *digests, s["chars"], s["problem"] is None, s["problem"])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            rows = []
            for conv, parts, problem in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if state and conv != key:
                    rows.append(row(key, state))
                    state = None
                key, state = conv, state or fresh()
                text = "".join(p["text"] for p in parts)
                for role, said in parse(text, template, pattern):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                lost = "".join(unescape(p["text"]) for p in parts if p["loss"])
                state["loss"].update(lost.encode())
                state["loss_chars"] += len(lost)
                state["chars"] += len(text)
                state["problem"] = problem
            if rows:
                yield batch(rows)
        if state:
            yield batch([row(key, state)])

    return _in_order(formatted.select("conv_id", "seq", "segments", "problem"), ["conv_id", "seq"]).mapInArrow(run, schema)


def sql(said: str, conv_id: int) -> str:
    """What read_chats() tells of the conversations table and one more conversation, a user and an assistant who both say the same."""
    t = INSTRUCT
    pattern = t.pattern().pattern.replace("'", "''")
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    esc = lambda c: f"regexp_replace({c}, '({pattern})', '\\\\\\1', 'g')"
    forms = " ".join(f"WHEN {quoted(r)} THEN {quoted(a)} || {esc('text')} || {quoted(b)}" for r, (a, b) in t.roles.items())
    other = f"{quoted(t.other[0])} || {esc('role')} || {quoted(t.other[1])} || {esc('text')} || {quoted(t.other[2])}"
    fine = " OR ".join(f"before = {quoted(s)} AND role IN ({', '.join(map(quoted, sorted(n)))})" for s, n in t.follows.items())
    loss = f"role IN ({', '.join(map(quoted, sorted(t.loss)))})"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT {conv_id}, 0, 'user', {quoted(said)} UNION ALL SELECT {conv_id}, 1, 'assistant', {quoted(said)}),
o AS (SELECT *, row_number() OVER w AS k, coalesce(lag(role) OVER w, '') AS before
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (SELECT *, CASE role {forms} ELSE {other} END AS formatted,
             CASE WHEN {fine} THEN NULL ELSE 'turn ' || (k - 1) || ': ' || coalesce(nullif(role, ''), 'no role')
               || ' after ' || coalesce(nullif(before, ''), 'the beginning') END AS problem FROM o),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
             coalesce(sum(length(text)) FILTER ({loss}), 0)::BIGINT AS loss_chars,
             sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER ({loss}), '')) AS loss_sha256,
             sum(length(formatted))::BIGINT AS formatted_chars,
             coalesce(arg_min(problem, k) FILTER (problem IS NOT NULL),
                      CASE WHEN NOT arg_max({loss}, k) THEN 'ends after ' || coalesce(nullif(arg_max(role, k), ''), 'the beginning') END) AS problem
      FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, problem IS NULL AS valid, problem FROM g"""
