"""Audit of filters that are applied one after another: radix text tries and masks.

Every document gets a mask, one bit for each filter that it fails. Four
filters look at the text alone; the last one, "the same text has a smaller
id", takes a dictionary of all texts: compressed tries (radix trees) whose
terminals hold the smallest id of a text.

1. Every task puts its texts into a trie of its own. A document that is not the
   smallest of its text there is a copy for certain and leaves as a mask; the
   others, one for each text of the task, go on. So a text that a third of all
   rows share travels once a task. A trie that has grown to ``TRIE_BYTES`` is
   handed on and a new one is begun.
2. The texts are range-partitioned by adaptive prefixes. Of a bounded sample of
   different texts the prefixes are counted, and those that weigh more than half
   a range are read on, four times as far in each round, until they
   part. A boundary is the shortest prefix that parts its neighbours. The
   boundaries steer the balance only; no result depends on the sample.
3. Every range inserts its whole texts into one trie. What a smaller id takes
   from its place leaves as a copy; at the end the tries are traversed and their
   terminals leave unmarked.

Masks are counted with the documents' labels by part, and 32 counts a part are
all that the 120 orders of the filters need.

Cases: null text is empty, null language the empty part, words end at ASCII
white space. Rows of equal id and text are not copies of each other (neither id
is smaller). A row without an id is never a copy and makes no other one. A
document counts as labelled if any of its rows in ``labels`` says so. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import cut, parallelism, slices, small_batches

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
SYMBOL = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
# Text bytes that one task holds in a trie, and that a range holds, about.
TRIE_BYTES = 64 << 20
RANGE_BYTES = 32 << 20
# Sampled texts for each range, and at most.
SAMPLE, SAMPLE_MOST = 32, 400_000
# A row's weight besides its text.
ROW_BYTES = 64


class Trie:
    """A compressed trie of byte strings. A node is [held, edges]: ``held`` is
    [smallest id, payloads of its rows] or None, ``edges`` maps a first byte to
    [label, node]."""

    def __init__(self):
        self.root, self.size = [None, {}], 0

    def _terminal(self, text: bytes) -> list:
        node, at = self.root, 0
        while at < len(text):
            edge = node[1].get(text[at])
            if edge is None:
                leaf = [None, {}]
                node[1][text[at]] = [text[at:], leaf]
                return leaf
            label, below = edge
            if not text.startswith(label, at):
                n = shared(label, text, at)
                middle = [None, {label[n]: [label[n:], below]}]
                edge[0], edge[1] = label[:n], middle
                label, below = label[:n], middle
            node, at = below, at + len(label)
        return node

    def insert(self, text: bytes, doc_id: int, payload: tuple) -> list[tuple[int, tuple]]:
        """Put the text in; return the rows that are now known to be copies."""
        node = self._terminal(text)
        held = node[0]
        if held is None:
            node[0] = [doc_id, [payload]]
            self.size += len(text) + ROW_BYTES
            return []
        if doc_id > held[0]:
            return [(doc_id, payload)]
        if doc_id == held[0]:
            held[1].append(payload)
            self.size += ROW_BYTES
            return []
        node[0] = [doc_id, [payload]]
        return [(held[0], p) for p in held[1]]

    def traverse(self):
        """text, smallest id and payload of every row still held, texts in ascending order."""
        todo = [(b"", self.root)]
        while todo:
            text, node = todo.pop()
            if node[0]:
                yield from ((text, node[0][0], p) for p in node[0][1])
            todo += [(text + label, below) for _, (label, below) in sorted(node[1].items(), reverse=True)]


def shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``text[at:]``, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def text_mask(text: bytes, n_chars: int) -> int:
    """The bits of the filters that look at one text."""
    words = text.split()
    failed = (len(words) < MIN_WORDS,
              100 * len(set(words)) < MIN_DISTINCT * len(words),
              100 * (len(text) - len(text.translate(None, CAPITALS))) > MAX_CAPITALS * n_chars,
              SYMBOL.search(text) is not None)
    return sum(bit << i for i, bit in enumerate(failed))


def boundaries(texts: DataFrame, n_ranges: int, n_rows: int, first_length: int = 16) -> list[bytes]:
    """At most ``n_ranges - 1`` ascending prefixes that cut the different texts
    (column ``text``, binary) into ranges of about equal weight."""
    every = max(1, n_rows // min(SAMPLE * n_ranges, SAMPLE_MOST))
    sample = cut(texts.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct())
    closed, length, heavy, total = [], first_length, None, 0
    while heavy is None or heavy:
        rows = sample if heavy is None else sample.filter(F.substring("text", 1, length // 4).isin(heavy))
        found = rows.groupBy(F.substring("text", 1, length).alias("prefix")).agg(
            F.sum(F.octet_length("text") + ROW_BYTES), F.count(F.lit(1)), F.max(F.octet_length("text"))).collect()
        total = total or sum(r[1] for r in found)
        is_heavy = [r[2] > 1 and r[3] > length and 2 * n_ranges * r[1] > total for r in found]
        heavy = [bytes(r[0]) for r, h in zip(found, is_heavy) if h]
        closed += [(bytes(r[0]), r[1]) for r, h in zip(found, is_heavy) if not h]
        length *= 4
    made, filled = [], 0
    closed.sort()
    for (before, weight), (after, _) in zip(closed, closed[1:]):
        filled += weight
        if filled * n_ranges >= total * (len(made) + 1) and len(made) < n_ranges - 1:
            made.append(after[:shared(before, after, 0) + 1])
    return made


def masks(docs: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "lang", trie_bytes: int = TRIE_BYTES,
          range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, part and mask of every row: bit i is set if it fails filter i of ``FILTERS``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n_rows, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_ranges = max(parallelism(spark), -(-n_bytes // range_bytes))
    edges = boundaries(rows.select(F.col("text").cast("binary").alias("text")), n_ranges, n_rows)

    def record(made: list[tuple], whole: bool) -> pa.RecordBatch:
        """Rows (range, doc_id, part, mask, text), or without range and text."""
        ranges, ids, parts, bits, texts = zip(*made)
        columns = [pa.array(ids, pa.int64()), pa.array(parts, pa.string()), pa.array(bits, pa.int32())]
        names = ["doc_id", "part", "mask"]
        if whole:
            columns, names = [pa.array(ranges, pa.int32()), *columns, pa.array(texts, pa.binary())], ["range", *names, "text"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def batched(rows_, whole: bool):
        made, size = [], 0
        for row in rows_:
            made.append(row)
            size += ROW_BYTES + len(row[4] or b"")
            if size > 1 << 20:
                yield record(made, whole)
                made, size = [], 0
        if made:
            yield record(made, whole)

    def collapse(batches):
        """Masks of sure copies (without text), and one row for each text of the task."""
        def run():
            trie = Trie()
            for piece in slices(batches):
                ids, parts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                n_chars = pc.utf8_length(piece.column(2)).to_pylist()
                for i, part_, n, own in zip(ids, parts, n_chars, piece.column(2).cast(pa.binary()).to_pylist()):
                    bits = text_mask(own, n)
                    if i is None:
                        yield (n, None, part_, bits, None)
                    else:
                        yield from ((j, j, p, b | COPY, None) for j, (p, b) in trie.insert(own, i, (part_, bits)))
                if trie.size > trie_bytes:
                    yield from hand_on(trie)
                    trie = Trie()
            yield from hand_on(trie)

        def hand_on(trie):
            return ((bisect_right(edges, t), i, p, b, t) for t, i, (p, b) in trie.traverse())

        # Rows without a text go wherever there is room.
        return batched(((r % n_ranges, i, p, b, t) for r, i, p, b, t in run()), True)

    def settle(batches):
        def run():
            trie = Trie()
            for piece in slices(batches):
                for _, i, part_, bits, own in zip(*[c.to_pylist() for c in piece.columns]):
                    if own is None:
                        yield (None, i, part_, bits, None)
                    else:
                        yield from ((None, j, p, b | COPY, None) for j, (p, b) in trie.insert(own, i, (part_, bits)))
            yield from ((None, i, p, b, None) for _, i, (p, b) in trie.traverse())

        return batched(run(), False)

    dealt = rows.mapInArrow(collapse, "range int, doc_id long, part string, mask int, text binary")
    return dealt.repartitionById(n_ranges, "range").mapInArrow(settle, "doc_id long, part string, mask int")


def counts(found: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n: rows of ``masks`` counted with their labels.

    Rows of one document are counted before the join, so an id that many rows
    share (null too) is one row in it."""
    flags = labels.groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n)
                                           for c, n in (("quality", "good"), ("toxic", "toxic"))]).filter("doc_id IS NOT NULL")
    documents = found.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    return (documents.join(flags, "doc_id", "left")
            .groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
            .agg(F.sum("n").alias("n")))


def report(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The effect of each filter in every order of the filters, by part."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    cases = [(f, sum(bit[g] for g in before), factorial(n) * factorial(len(filters) - 1 - n))
             for f in filters for n in range(len(filters)) for before in combinations([g for g in filters if g != f], n)]
    steps = [("".join(order), k + 1, f, sum(bit[g] for g in order[:k])) for order in permutations(filters) for k, f in enumerate(order)]
    case = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(bit[f]).alias("own"), F.lit(b).alias("before"), F.lit(w).alias("weight"))
                               for f, b, w in cases]))
    spread = counted.select("*", case.alias("c")).select("part", "mask", "good", "toxic", "n", "c.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    count = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    effects = spread.groupBy("part", "filter", "before", "weight").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"),
        count(F.col("mask") == F.col("own")).alias("unique_fails"),
        count(fails & ~gone & (F.col("good") == 1)).alias("good_lost"), count(fails & ~gone & (F.col("toxic") == 1)).alias("toxic_lost"))
    shapley = effects.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    places = counted.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before int")
    return (effects.join(shapley, ["part", "filter"]).join(F.broadcast(places), ["filter", "before"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def audit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``report`` over the masks of ``docs`` and ``labels`` (doc_id, quality, toxic)."""
    return report(cut(counts(masks(docs, doc, text, part), labels)))
