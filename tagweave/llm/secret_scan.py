"""Secret scans with corpus-wide ownership frequency.

``scan`` finds candidate credentials in every whole text: three base kinds,
which are always reported, and further kinds that are reported only if they
look alive and belong to few owners. Every candidate's value is hashed; the
hashes are aggregated over the whole corpus by distinct owner (the source of a
document) and distinct repository (the document). A value that more owners
than ``max_owners`` hold, or more repositories than ``max_repositories`` (an example
that one owner copies everywhere), is widely copied; a rarer one that is not a
placeholder is owner-specific.

``redact`` replaces every reported span of the documents by its kind.

Nothing but hashes, offsets and counts is shuffled: texts stay where they are
read (``redact`` joins the spans back, see there). The counts are aggregated
first per value, owner and repository, then per value and owner, then per
value, so a value held by a third of all rows is a partial sum in every task.

Cases: a null text counts as empty; a null owner is an owner of its own;
documents without candidates are returned with no spans; repeated rows give
equal rows (one repository, counted once); a document id may be null; only id,
owner and text are read (``redact`` keeps all columns), and a column that has the
name of ``find_candidates``' result is replaced; an empty table gives an empty
result. All patterns take time linear in the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.sizing import bounded_broadcast
from tagweave.llm.common import cut, free_name, map_rows

# The base kinds, in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = ("assign", "access", "hex")
# Further kinds: formats of well-known credentials, and bare high-entropy strings.
MORE = {
    "bearer": re.compile(r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]{20,})"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "vendor": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,})"),
    "url": re.compile(r"[a-z][a-z0-9+]{1,15}://[^\s:/@]{1,64}:([^\s:/@]{6,128})@"),
    "key_block": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),  # see key_end
    "entropy": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])"),
}
KINDS = BASE + tuple(MORE)
KEY_END = re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
# Lines of a key without an END line, line ends written out or escaped: headers, whole lines, a short last one.
_BREAK = r"(?:\s|\\[nr])"
KEY_LINES = re.compile(rf"(?:{_BREAK}+(?:Proc-Type|DEK-Info): [^\n\\]*)*(?:(?:{_BREAK}+[A-Za-z0-9+/]{{64,}}={{0,2}}(?![^\s\\\"']))+"
                       rf"(?:{_BREAK}+[A-Za-z0-9+/]+={{0,2}}(?=\x20*(?:[\r\n\\\"']|\Z)))?|{_BREAK}+[A-Za-z0-9+/]+={{0,2}}(?={_BREAK}*\Z))?")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your[_-]|xxxx|1234567|abcdef", re.IGNORECASE)
# Bits per character from which a string without a known format counts as random.
MIN_ENTROPY = 3.5
# Owners and repositories up to which a value is owner-specific.
MAX_OWNERS = 2
MAX_REPOSITORIES = 20

CANDIDATE = T.ArrayType(T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("value", T.LongType()), T.StructField("live", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                             ("value", pa.int64()), ("live", pa.bool_())]))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def key_end(text: str, at: int) -> int:
    """Where the key ends whose header ends at ``at``: after its END line if no
    other block begins before that, else after the lines of a key that follow
    (a text may end in one)."""
    stop = text.find("-----BEGIN ", at)
    stop = len(text) if stop < 0 else stop
    return (KEY_END.search(text, at, stop) or KEY_LINES.match(text, at, stop)).end()


def held_value(kind: str, found: str) -> str:
    """What owners are counted by: of a key block its body without white space,
    written out or escaped (the header alone where there is no body)."""
    if kind != "key_block":
        return found
    body = KEY_END.sub("", MORE[kind].sub("", found))
    return re.sub(r"\s|\\[nr]", "", body) or found


def looks_live(kind: str, value: str) -> bool:
    if PLACEHOLDER.search(value) or len(set(value)) < 6:
        return kind == "key_block"
    if kind == "entropy":
        return entropy(value) >= MIN_ENTROPY and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return True


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the base kinds, by start, then kind."""
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str) -> list[dict]:
    """All candidates of a text, by start, then kind; the value as a hash."""
    found = base_spans(text)
    for kind, pattern in MORE.items():
        found.sort(key=lambda s: s[1])
        starts, reach = [s[1] for s in found], list(accumulate((s[2] for s in found), max))
        for m in pattern.finditer(text):
            group = 1 if m.re.groups else 0
            begin, end = m.start(group), key_end(text, m.end()) if kind == "key_block" else m.end(group)
            before = bisect_right(starts, begin)
            if not before or reach[before - 1] < end:  # else an earlier kind holds it already
                found.append((KINDS.index(kind), begin, end, text[begin:end]))
    return [{"kind": k, "start": a, "end": b, "live": looks_live(KINDS[k], v),
             "value": int.from_bytes(hashlib.blake2b(held_value(KINDS[k], v).encode(), digest_size=8).digest(), "big", signed=True)}
            for k, a, b, v in sorted(found, key=lambda s: (s[1], s[0]))]


def find_candidates(df: DataFrame, text: str = "text", keep: list[str] | None = None,
                    out: str = "candidates") -> DataFrame:
    """Add the array of candidates to every row."""
    at = df.columns.index(text)

    def start():
        return lambda piece: [pa.array([candidates(t or "") for t in piece.column(at).to_pylist()], _ARROW)]

    return map_rows(df, [T.StructField(out, CANDIDATE)], start, keep=keep)


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """value, owners, repositories: how widely each candidate value is held."""
    held = found.select(F.explode("candidates.value").alias("value"), F.col(owner).alias("owner"), F.col(repository).alias("repo"))
    per_repo = held.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("uses"))
    per_owner = per_repo.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return per_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def scan(df: DataFrame, doc: str = "doc_id", text: str = "text", owner: str = "source",
         max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per document: ``doc``, ``base`` and ``spans`` (arrays of
    kind:start:end, as strings in order), counts by base kind, and how many
    spans hold owner-specific and widely copied values."""
    rows = df.select(F.col(doc).alias("doc_id"), F.col(owner).alias("owner"), F.col(text).alias("text"))
    found = cut(find_candidates(rows, keep=["doc_id", "owner"]).withColumn("row", F.monotonically_increasing_id()))
    counts = ownership(found, "doc_id", "owner")
    each = found.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    wide = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    judged = (each.join(counts.withColumn("wide", wide), "value")
              .withColumn("specific", F.col("live") & ~F.col("wide"))
              .filter((F.col("kind") < len(BASE)) | F.col("specific"))
              .groupBy("row").agg(
                  F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("s"),
                  F.count_if("specific").alias("n_owner_specific"),
                  F.count_if("wide").alias("n_widely_copied")))
    names = F.array(*[F.lit(k) for k in KINDS])
    label = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    spans = F.coalesce("s", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))

    def count(kind: int):  # a second parameter of the lambda would be the span's index
        return F.size(F.filter(spans, lambda s: s["kind"] == kind))

    out = found.join(judged, "row", "left")
    return out.select(
        "doc_id",
        *[count(k).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.transform(base, label).alias("base"), F.transform(spans, label).alias("spans"),
        F.coalesce("n_owner_specific", F.lit(0)).cast("long").alias("n_owner_specific"),
        F.coalesce("n_widely_copied", F.lit(0)).cast("long").alias("n_widely_copied"))


def redact(df: DataFrame, doc: str = "doc_id", text: str = "text", owner: str = "source", length: str | None = None,
           max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """The rows of ``df`` with every reported span replaced by ``[kind]``.

    ``length`` names a column that holds the text's length, kept in step. Only
    rows with spans are looked up, by document and text hash: their table is
    broadcast below a checked size, else joined by a shuffle.
    """
    at, mark = free_name("__text_hash", df), free_name("__spans", df)
    marked = df.withColumn(at, F.xxhash64(text))
    id_name = free_name("__doc", df)
    keyed = marked.select(F.struct(doc, at).alias("key"), F.col(owner).alias("owner"), F.col(text).alias("text"))
    spans = (scan(keyed, "key", "text", "owner", max_owners, max_repositories).filter(F.size("spans") > 0)
             .select(F.col("doc_id")[doc].alias(id_name), F.col("doc_id")[at].alias("__h"), F.col("spans").alias(mark))
             .dropDuplicates([id_name, "__h"]))
    small = bounded_broadcast(spans, max_rows=500_000, max_bytes=32 << 20)
    joined = marked.join(small, marked[doc].eqNullSafe(small[id_name]) & (marked[at] == small["__h"]), "left")
    changed = joined.select(*[marked[c] for c in df.columns], mark)
    columns, where = list(df.columns), changed.columns.index(text)
    lengths = columns.index(length) if length else None
    schema = df.schema

    def run(batches):
        for batch in batches:
            texts, marks = batch.column(where).to_pylist(), batch.column(len(columns)).to_pylist()
            done = [clean(t, m) if m else t for t, m in zip(texts, marks, strict=True)]
            arrays = list(batch.columns[:len(columns)])
            arrays[where] = pa.array(done, arrays[where].type)
            if lengths is not None:
                had = arrays[lengths].to_pylist()
                arrays[lengths] = pa.array([len(d) if m else n for d, m, n in zip(done, marks, had, strict=True)], arrays[lengths].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return changed.mapInArrow(run, schema)


def clean(text: str, spans: list[str]) -> str:
    """The text with its spans replaced; overlapping spans go as one."""
    cuts: list[list] = []
    for span in spans:
        kind, start, end = span.split(":")
        if cuts and int(start) < cuts[-1][1]:
            cuts[-1][1] = max(cuts[-1][1], int(end))
        else:
            cuts.append([int(start), int(end), kind])
    out, at = [], 0
    for start, end, kind in cuts:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])
