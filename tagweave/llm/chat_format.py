"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Role: text`` and a closing line ``</turn>``. What
is rendered is parsed again by a deterministic parser; if the recovered turn
differs from the source, or the parser finds a control string where text
should be, the text is escaped (a backslash before every control string in
it) and rendered again, until the recovered turn is identical. The parser
takes a control string right behind a backslash for text and drops that
backslash, so texts that hold backslashes before control strings survive too.

Rendering works row by row. Reading back streams each conversation's rendered
turns in order through the parser with running digests, so a conversation of
any length needs the memory of one batch; the sort before it spills.

Cases: null text is empty; a null role is the empty role; roles outside the
four known ones are written percent-encoded; rows with equal conversation and
turn are ordered by role, then by rendered turn; repeated rows stay repeated
turns; null conversation ids form one conversation; null turns come first; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import map_rows, slices

# The template: names of the known roles, the closing line, the control strings.
NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
END = "\n</turn>\n"
HEADER = re.compile(r"### ([A-Za-z0-9%_.~-]*): ")
CONTROL = re.compile(r"### [A-Za-z0-9%_.~-]*: |</turn>")
ESCAPE = "\\"
OTHER = "role."
LEARNED_ROLE = "assistant"


class GrammarError(ValueError):
    """The text is not a sequence of rendered turns."""


def render(role: str, text: str) -> str:
    name = NAMES.get(role) or OTHER + quote(role, safe="")
    return f"### {name}: {text}{END}"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: ESCAPE + m[0], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of rendered text; raises GrammarError on anything else."""
    roles = {name: role for role, name in NAMES.items()}
    turns, at = [], 0
    while at < len(formatted):
        header = HEADER.match(formatted, at)
        if not header:
            raise GrammarError(f"no turn begins at {at}")
        name = header[1]
        if name not in roles and not name.startswith(OTHER):
            raise GrammarError(f"unknown role {name!r}")
        parts, done, begin = [], None, header.end()
        at = begin
        for control in CONTROL.finditer(formatted, begin):
            if control.start() > begin and formatted[control.start() - 1] == ESCAPE:
                parts.append(formatted[at:control.start() - 1])
                at = control.start()
                continue
            if not formatted.startswith(END, control.start() - 1) or control.start() == begin:
                raise GrammarError(f"control string inside a turn at {control.start()}")
            parts.append(formatted[at:control.start() - 1])
            done = control.start() - 1 + len(END)
            break
        if done is None:
            raise GrammarError("a turn does not end")
        turns.append((roles.get(name, unquote(name[len(OTHER):])), "".join(parts)))
        at = done
    return turns


def format_turn(role: str | None, text: str | None) -> str:
    """Rendered text that parses back to exactly this turn."""
    turn = (role or "", text or "")
    for content in (turn[1], escape(turn[1])):
        formatted = render(turn[0], content)
        try:
            if parse(formatted) == [turn]:
                return formatted
        except GrammarError:
            continue
    raise AssertionError("escaped text does not parse back")


def format_turns(df: DataFrame, role: str = "role", text: str = "text", out: str = "formatted") -> DataFrame:
    """Add the rendered turn to every row."""
    r, t = df.columns.index(role), df.columns.index(text)

    def start():
        return lambda piece: [pa.array([format_turn(a, b) for a, b in zip(
            piece.column(r).to_pylist(), piece.column(t).to_pylist(), strict=True)], pa.string())]

    return map_rows(df, [T.StructField(out, T.StringType())], start)


def read_back(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              formatted: str = "formatted") -> DataFrame:
    """Per conversation, from its rendered turns alone: how many turns parse
    out, the digest of roles and texts, and length and digest of the text under
    the loss mask (the assistant's)."""
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                     F.col(formatted).alias("formatted"))
    ordered = (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
               .select("conv_id", "formatted"))
    schema = T.StructType([ordered.schema["conv_id"]] + [
        T.StructField(n, T.StringType() if n.endswith("sha256") else T.LongType())
        for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")])

    def run(batches):
        key_type = None
        current, state = None, None

        def row(key, s):
            return key, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

        def record(done):
            arrays = list(zip(*done, strict=True))
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types, strict=True)],
                                              names=[f.name for f in schema.fields])

        for piece in slices(batches):
            key_type, done = piece.column(0).type, []
            for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                if state is None or key != current:
                    if state is not None:
                        done.append(row(current, state))
                    current, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for said_by, content in parse(text):
                    state[0] += 1
                    state[1].update(f"{said_by}\n{content}\n".encode())
                    if said_by == LEARNED_ROLE:
                        state[2] += len(content)
                        state[3].update(content.encode())
                state[4] += len(text)
            if done:
                yield record(done)
        if state is not None:
            yield record([row(current, state)])

    return ordered.mapInArrow(run, schema)
