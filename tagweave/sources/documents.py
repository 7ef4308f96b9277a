"""JSON documents read by many tasks (O-S3).

A document is read as text that ends at commas, so Spark cuts a file into byte
ranges like any text file. A range cannot be understood by itself: whether it
begins inside a string, and how deep, depends on all ranges before it. So every
range is scanned once for its effect (does it flip "inside a string", by how
much does it change the depth when it begins outside or inside one), two running
sums over a file's ranges (a few numbers each) give the state that each range
begins with, and a second scan cuts the ranges into records. Records within a
range are complete; only those that cross ranges are put together, by one group
for each of them. The scans are array operations over whole buffers, and a
record's text goes to the JVM's parser as it stands.

Records are the elements of top-level lists and, in documents that do not begin
with a list, the top-level values.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.session import checkpoint_dir

# The scans run in Python workers that need not have this package.
register_pickle_by_value(sys.modules[__name__])

BUFFER_BYTES = 1 << 20
_STEP = np.zeros(256, np.int64)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1
QUOTE, BACKSLASH, COMMA, NEWLINE = 0x22, 0x5C, 0x2C, 0x0A
OPEN, CLOSE = 0x5B, 0x5D


def open_quotes(data: np.ndarray) -> np.ndarray:
    """1 at every quote that no backslash escapes."""
    quote = (data == QUOTE).astype(np.int64)
    back = data == BACKSLASH
    if back.any():
        at = np.flatnonzero(quote)
        at = at[at > 0]
        last_other = np.maximum.accumulate(np.where(back, -1, np.arange(len(data))))
        quote[at[(at - 1 - last_other[at - 1]) % 2 == 1]] = 0
    return quote


def effect(data: np.ndarray) -> tuple[int, int, int]:
    """Quotes, and the change of depth for a start outside and inside a string."""
    quotes = np.cumsum(open_quotes(data))
    step, inside = _STEP[data], quotes % 2
    return int(quotes[-1]) if len(data) else 0, int(step[inside == 0].sum()), int(step[inside == 1].sum())


def cuts(data: np.ndarray, inside: int, depth: int, is_list: bool) -> tuple[np.ndarray, int, int]:
    """Where records are cut (places of single bytes, or one past a value's end), and the state at the end."""
    quotes = np.cumsum(open_quotes(data)) + inside
    step = np.where(quotes % 2 == 0, _STEP[data], 0)
    level = np.cumsum(step) + depth
    outside = quotes % 2 == 0
    if is_list:
        here = outside & (((data == COMMA) & (level == 1)) | ((data == OPEN) & (step == 1) & (level == 1)) | ((data == CLOSE) & (step == -1) & (level == 0)))
    else:
        here = outside & (level == 0) & ((step == -1) | (data == NEWLINE))
    end = (int(quotes[-1]) % 2, int(level[-1])) if len(data) else (inside, depth)
    return np.flatnonzero(here), *end


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """(key, buffer) of the rows' texts (the last column), joined by commas and
    ended by one; a buffer holds rows of one batch and one key (the other
    columns) and, beyond one row, about BUFFER_BYTES. Keys are taken once for
    each stretch of rows, not for each row."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        changes = np.zeros(rows - 1, bool)
        for c in batch.columns[:2]:  # the file and the place of the range tell the other columns
            changes |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, rows - 1)), True).to_numpy(zero_copy_only=False)
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1)
        bounds = [0, *(np.flatnonzero(changes) + 1).tolist(), rows]
        for start, stop in zip(bounds, bounds[1:]):
            key = tuple(c[start].as_py() for c in batch.columns[:-1])
            while start < stop:
                before = ends[start - 1] if start else 0
                end = min(stop, max(start + 1, int(np.searchsorted(ends, before + BUFFER_BYTES))))
                piece = texts.slice(start, end - start)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), piece), b",")
                yield key, joined[0].as_py() + b","
                start = end


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """((file, block, ...), buffers) of every byte range, in order; buffers end with a comma."""
    for key, own in groupby(_buffers(batches), key=lambda x: x[0]):
        yield key, (data for _, data in own)


def _effects(batches):
    for (name, block), buffers in _ranges(batches):
        quotes, outside, inside, first, size = 0, 0, 0, None, 0
        for data in buffers:
            if first is None:
                start = data.lstrip(b"\xef\xbb\xbf \t\r\n")[:1]
                first = start == b"[" if start not in (b"", b",") else None
            q, a, b = effect(np.frombuffer(data, np.uint8))
            outside, inside = outside + (b if quotes % 2 else a), inside + (a if quotes % 2 else b)
            quotes += q
            size += len(data)
        yield pa.RecordBatch.from_pydict({
            "file_name": [name], "block": [block], "flips": [quotes % 2], "outside": [outside], "inside": [inside], "is_list": pa.array([first], pa.bool_())})


def classify(is_list: bool, opened: str, closed: str, text: bytes, single: bool) -> str | None:
    """What a record is; None for blanks and for what the document's end cuts off.

    ``opened`` and ``closed`` are the bytes that cut it out, '' at the start and
    the end of a document. Elements are blank in an empty list only, and beside
    lists there are blanks only."""
    blank = not text.strip(b" \t\r\n")
    if not is_list:
        return None if blank else "value" if single else "line"
    if opened not in ("[", ","):
        return None if blank else "error"
    if not closed or (opened, closed) == ("[", "]") and blank:
        return None
    return "error" if blank else "item"


RECORDS = "file_name string, block long, ord long, kind string, opened string, closed string, others long, is_list boolean, text string"


def _records(batches, crossing: bool = False):
    """The records of every range or, if ``crossing``, its parts of records that
    cross ranges (kind null; ``others``: complete records of the range beside it)."""
    def batch(rows):
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
        made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays([*made[:-1], made[-1].cast(pa.string())], names=[x.split()[0] for x in RECORDS.split(", ")])

    for (name, block, inside, depth, is_list, last_block, broken), buffers in _ranges(batches):
        lines = last_block > 0 or name.rpartition("/")[2].startswith("part-")  # what Spark's writers name JSON Lines
        rows, size, order, complete, parts, rest, opened = [], 0, 0, 0, [], b"", ""

        def put(closed, text):
            nonlocal size, order, complete, opened
            if not block and not order:
                text = text.removeprefix(b"\xef\xbb\xbf")
            if not closed and block == last_block:
                text = text[:-1]  # the comma that ends the last buffer
            if (block and not order) or (not closed and block < last_block):
                parts.append((order, opened, closed, text))
            elif not closed and broken:
                pass  # what the document's end cuts off is told once
            elif kind := classify(is_list, opened, closed, text, False):
                complete += 1
                if not crossing:
                    rows.append((name, block, order, kind, opened, closed, 0, is_list, text))
                    size += len(text)
            order, opened = order + 1, closed

        for data in buffers:
            at, inside, depth = cuts(np.frombuffer(data, np.uint8), inside, depth, is_list)
            begin = 0
            for i in at.tolist():
                put(chr(data[i]), rest + data[begin:i if is_list else i + 1])
                rest, begin = b"", i + 1
                if size > 1 << 22 and len(rows) > 1:
                    yield batch(rows)
                    rows, size, lines = [], 0, True
            rest += data[begin:]
        put("", rest)
        if not lines and len(rows) == 1 and not is_list:
            rows = [(*rows[0][:3], "value", *rows[0][4:])]
        if crossing:
            rows = [(name, block, o, None, a, b, complete, is_list, text) for o, a, b, text in parts]
        if rows:
            yield batch(rows)


def _put_together(batches):
    for held in batches:
        rows = [(f, b, o, classify(li, x, y, t, s), t) for f, b, o, li, x, y, s, t in zip(
            *[c.to_pylist() for c in held.columns[:-1]], held.column(held.num_columns - 1).cast(pa.binary()).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, t) for c, t in zip(list(zip(*rows))[:4], [pa.string(), pa.int64(), pa.int64(), pa.string()])], held.column(held.num_columns - 1)]
            if rows else held.columns[:3] + [pa.array([], pa.string()), held.column(held.num_columns - 1)],
            names=["file_name", "block", "ord", "kind", "text"])


def document_texts(spark: SparkSession, path, glob: str | None = "*.json", recursive: bool = False) -> DataFrame:
    """(file_name, kind, doc, block, row) of every record of the documents under
    ``path``: ``item`` for elements of a list, ``value`` for a document's only
    value, ``line`` for one of several; a row of kind ``error`` for what is no
    record and for a document that ends inside a value. (block, row) is the
    place of a record's beginning in its file."""
    r = spark.read.format("text").option("lineSep", ",")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    pieces = r.load(list(path) if isinstance(path, (list, tuple)) else [path]).select(
        F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), "value")
    effects = pieces.mapInArrow(_effects, "file_name string, block long, flips long, outside long, inside long, is_list boolean")
    before = W.partitionBy("file_name").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("file_name")
    checkpoint_dir(spark)
    states = (effects.withColumn("within", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
              .withColumn("change", F.when(F.col("within") == 0, F.col("outside")).otherwise(F.col("inside")))
              .withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
              .withColumn("is_list", F.coalesce(F.min_by("is_list", F.when(F.col("is_list").isNotNull(), F.col("block"))).over(whole), F.lit(False)))
              .withColumn("last_block", F.max("block").over(whole))
              .withColumn("broken", F.max_by((F.col("depth") + F.col("change") != 0) | ((F.col("within") + F.col("flips")) % 2 == 1), "block").over(whole))
              ).checkpoint(eager=True)
    # One narrow row for each byte range that Spark reads: bounded by their number.
    narrow = F.broadcast(states.select("file_name", "block", "within", "depth", "is_list", "last_block", "broken"))
    ranged = pieces.join(narrow, ["file_name", "block"]).select("file_name", "block", "within", "depth", "is_list", "last_block", "broken", "value")
    found = ranged.mapInArrow(_records, RECORDS)
    # Parts of records: one that begins in its range opens a group, those that go on belong to the last one opened.
    # The window holds two narrow rows a range. Parts are read three times and written once: they hold one record a range.
    parts = ranged.mapInArrow(lambda batches: _records(batches, crossing=True), RECORDS).checkpoint(eager=True)
    begins = ((F.col("ord") > 0) | (F.col("block") == 0)).cast("int")
    owned = parts.select("file_name", "block", "ord").withColumn("owner", F.sum(begins).over(W.partitionBy("file_name").orderBy("block", "ord")))
    piece = F.struct("block", "ord", "opened", "closed", "text")
    groups = (parts.join(owned, ["file_name", "block", "ord"]).groupBy("file_name", "is_list", "owner")
              .agg(F.array_sort(F.collect_list(piece)).alias("p"), F.sum("others").alias("others"))
              .join(narrow.where("block = 0").select("file_name", "last_block", "broken"), "file_name")
              .where(~F.col("broken") | (F.element_at("p", -1)["closed"] != "")))
    first, last = F.get("p", 0), F.element_at("p", -1)
    single = (F.col("others") == 0) & (first["block"] == 0) & (last["block"] == F.col("last_block"))
    crossing = groups.select("file_name", first["block"].alias("block"), first["ord"].alias("ord"), "is_list", first["opened"].alias("opened"),
                             last["closed"].alias("closed"), single.alias("single"),
                             F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    crossing = crossing.mapInArrow(_put_together, "file_name string, block long, ord long, kind string, text string").where("kind IS NOT NULL")
    every = found.select("file_name", "block", "ord", "kind", "text").unionByName(crossing)
    doc = F.when(F.col("kind") == "error", F.concat(F.lit("no value where one is expected: "), F.substring("text", 1, 80))).otherwise(F.col("text"))
    ended = states.where("block = last_block AND broken")
    return every.select("file_name", "kind", doc.alias("doc"), "block", F.col("ord").alias("row")).unionByName(
        ended.select("file_name", F.lit("error").alias("kind"), F.lit("the document ends inside a value").alias("doc"), "block",
                     F.lit(None).cast("long").alias("row")))
