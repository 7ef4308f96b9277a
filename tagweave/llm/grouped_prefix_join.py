"""Near-duplicates by the Jaccard likeness of shingle sets: a grouped prefix join.

Two documents link when their sets of word shingles are alike by at least
``percent``. With all shingles in one global order, rare ones first, two such
sets share a shingle among their first n - ceil(percent n / 100) + 1, the
prefix. Documents with identical prefixes and sizes form a group, groups meet
in the lists of their prefix shingles, pairs of groups are filtered by size and
place, and only what is left is expanded to members and verified on the whole
sets.

1. Blocks of texts are packed once (compressed, in the shared checkpoint folder).
   A block lists its distinct shingles, as sorted differences of shortened
   hashes, by hash range; a range counts them over all blocks and answers each
   block with one small number a shingle: in how many documents it is. So counts
   cover the corpus, and what travels is about two bytes a shingle. Shortened
   hashes may count two shingles as one; the order stays the same for all.
2. A document whose prefix consists of shingles that no other document has
   links with nothing and is done. Of the others, equal sets (a 128-bit digest)
   become one; shingles of one document alone are dropped from the sets, as
   they match nothing, and counted in the sizes.
3. Star step: in each list, and for each class of sizes that differ by up to a
   quarter, every group is verified against the group with the fewest shingles of
   its own (the original, where the others are its edited copies), and every
   member against its group's first. That costs a row a posting however long the
   list is, and joins the members of a cluster.
4. Exact step: pairs in a list that are not known to be linked over others. Lists
   of sets that all are are left out, and in the others the members of the commonest
   cluster meet only those outside it. Four bounds on what two sets share
   decide within the join: their sizes; the places of the shingle (the first that
   two sets share is in the lists of both, and all others come after it); the
   shingles that only one document has; and 256 parity bits of each set, which
   differ in no more places than the sets do. What is left is expanded to
   members of different components, and verified.

Links that stay unverified are inside a component already, so the components,
worked out of all verified links at the end, are exact. Shingles are 64-bit hashes; sets of one document with a wrong match are
as unlikely as one in 10^12 for 10,000 words.

Cases: A-Z are lower-cased, words end at ASCII white space. Fewer words than a
shingle has: the whole sequence is the one shingle. Null text and text without
words have an empty set, link with nothing, and are their own component. Equal
rows link like any others. A null id never names a component (one of null ids
only has a null id). Only the id and the text are read, so other columns cannot
clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import cut, parallelism, small_batches
from tagweave.llm.components import components
from tagweave.llm.ngram_lm import extend, pack, tokens, unpack

WORDS = 5
PERCENT = 80
# Text bytes of a block at least and at most (between, a block grows with the root of the corpus), and shingles in a range, about.
BLOCK_LEAST, BLOCK_MOST = 4 << 20, 32 << 20
RANGE_ROWS = 4 << 20
# Shortened hashes have so many bits more than the number of shingles has.
SPARE_BITS = 4
# Parity bits of a set, in 64-bit words.
PARITY_WORDS = 4
# Rows verified at once; sets may be long.
VERIFY_ROWS = 64


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found, counts = tokens(texts)  # an end token after each text
    begin = np.cumsum(counts) - counts
    place, n = np.arange(len(found)) - np.repeat(begin, counts), np.repeat(counts - 1, counts)
    made, there, chain = np.zeros_like(found), np.zeros(len(found), bool), found
    for k in range(1, words + 1):
        if k > 1:
            chain = np.concatenate([np.zeros(1, np.uint64), extend(chain[:-1], found[1:])])
        ends = (place >= k - 1) & (place < n)
        if k < words:
            ends &= n == k
        made[ends] = chain[ends]
        there |= ends
    return [np.unique(made[b:b + c][there[b:b + c]]) for b, c in zip(begin.tolist(), counts.tolist())]


def prefix_length(n, percent: int = PERCENT):
    """First shingles of a set of n among which a partner has one too."""
    return n - -(-percent * n // 100) + 1


def size_class(n: int, percent: int = PERCENT) -> int:
    return int(math.log(n) / math.log(100 / percent)) if percent < 100 else n


def frequency_class(n: np.ndarray) -> np.ndarray:
    """One byte that grows with the number of documents; 0: a single one."""
    return np.where(n < 128, n - 1, np.minimum(255, 120 + np.log2(np.maximum(n, 1)).astype(np.int64))).astype(np.uint8)


def pack_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """block, ids, packed: neighbouring documents of a task, their lengths and texts compressed."""
    def run(batches):
        press, ids, texts, size = zstandard.ZstdCompressor(level=3), [], [], 0

        def block():
            lengths = np.array([len(t) for t in texts], "<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([press.compress(lengths + b"".join(texts))], pa.binary())],
                                              names=["ids", "packed"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).fill_null("").cast(pa.binary()).to_pylist()):
                ids.append(i)
                texts.append(text)
                size += len(text) + 64
                if size >= block_bytes:
                    yield block()
                    ids, texts, size = [], [], 0
        if ids:
            yield block()

    return cut(rows.mapInArrow(run, "ids array<long>, packed binary").withColumn("block", F.monotonically_increasing_id()))


def unpack_block(ids: pa.Scalar, packed: pa.Scalar) -> tuple[list, list[bytes]]:
    ids, data = ids.as_py(), zstandard.ZstdDecompressor().decompress(packed.as_buffer())
    ends = np.cumsum(np.frombuffer(data, "<i8", len(ids))) + 8 * len(ids)
    return ids, [data[a:b] for a, b in zip([8 * len(ids), *ends[:-1].tolist()], ends.tolist())]


def shortened(sets: list[np.ndarray], bits: int) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *sets]) >> np.uint64(64 - bits)


def range_edges(keys: np.ndarray, bits: int, range_bits: int) -> np.ndarray:
    """Where each hash range begins in the sorted shortened hashes, and their end."""
    bounds = np.arange(1 << range_bits, dtype=np.uint64) << np.uint64(bits - range_bits)
    return np.concatenate([np.searchsorted(keys, bounds), [len(keys)]])


def list_shingles(block: int, texts: list[bytes], words: int, bits: int, range_bits: int) -> list[tuple]:
    """(range, block, size, differences, documents) of the block's shingles."""
    keys, held = np.unique(shortened(shingle_sets(texts, words), bits), return_counts=True)
    edges, rows = range_edges(keys, bits, range_bits), []
    for r in np.flatnonzero(np.diff(edges)).tolist():
        own = keys[edges[r]:edges[r + 1]]
        rows.append((r, block, len(own), pack(np.diff(own, prepend=np.uint64(r << bits - range_bits))), pack(held[edges[r]:edges[r + 1]])))
    return rows


def count_range(sizes: list[int], differences: list[bytes], held: list[bytes]) -> list[bytes]:
    """For each block its shingles' frequency classes, in its own order."""
    keys = np.concatenate([np.cumsum(unpack(d, n), dtype=np.uint64) for d, n in zip(differences, sizes)])
    found, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([unpack(h, n) for h, n in zip(held, sizes)]), minlength=len(found))
    answer = frequency_class(total.astype(np.int64))[inverse]
    ends = np.cumsum(sizes).tolist()
    return [answer[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]


def digest(*parts: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=size).digest()


def parity(own: np.ndarray) -> list[int]:
    """For each of the hash ranges whether an odd number of the set's shingles is in it, as 64-bit integers."""
    size = 64 * PARITY_WORDS
    odd = np.bincount((own >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd, bitorder="little").view("<i8").tolist()


def settle_block(ids: list, texts: list[bytes], classes: np.ndarray, words: int, bits: int, percent: int) -> dict[str, list]:
    """One row per document. Of those that may link: set_id, group and single
    (shingles of this document alone); the set's other shingles with its parity
    bits, and the group's prefix, stand with the first of each in the block."""
    sets = shingle_sets(texts, words)
    inverse = np.unique(shortened(sets, bits), return_inverse=True)[1]
    at, seen = 0, set()
    out = {c: [] for c in ("doc_id", "n_shingles", "set_id", "grp", "single", "tokens", "parity", "prefix")}
    for i, own in zip(ids, sets):
        n, rank = len(own), classes[inverse[at:at + len(own)]]
        at += n
        row = [i, n, None, None, None, None, None, None]
        single = int((rank == 0).sum())
        if n and single < prefix_length(n, percent):
            shared, rank = own[rank > 0], rank[rank > 0]
            prefix = shared[np.lexsort((shared, rank))][:prefix_length(n, percent) - single].tobytes()
            set_id, name = digest(own.tobytes()), digest(n.to_bytes(8, "little"), single.to_bytes(8, "little"), prefix)
            row[2:5] = set_id, int.from_bytes(name[:8], "little", signed=True), single
            if set_id not in seen:
                row[5], row[6] = shared.tobytes(), parity(own)
            if name not in seen:
                row[7] = prefix
            seen |= {set_id, name}
        for c, x in zip(out.values(), row):
            c.append(x)
    return out


def settled_documents(rows: DataFrame, words: int, percent: int, block_least: int, range_rows: int) -> DataFrame:
    """Steps 1 and 2 for rows (doc_id long, text)."""
    spark = rows.sparkSession
    small_batches(spark)
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_shingles = n_bytes / 6 + 2
    range_bits = max(math.ceil(math.log2(parallelism(spark))), math.ceil(math.log2(n_shingles / range_rows)))
    bits = min(64, max(range_bits, math.ceil(math.log2(n_shingles)) + SPARE_BITS))
    blocks = pack_blocks(rows, min(BLOCK_MOST, max(block_least, int(512 * math.sqrt(n_bytes)))))

    def ask(batches):
        for batch in batches:
            for ids, packed, block in zip(*batch.columns):
                listed = list_shingles(block.as_py(), unpack_block(ids, packed)[1], words, bits, range_bits)
                if listed:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*listed), asked.types)], names=asked.names)

    asked = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("size", pa.int32()), ("differences", pa.binary()), ("held", pa.binary())])

    def answer(key, listed):
        return pa.table({"block": listed["block"], "range": listed["range"], "classes": pa.array(
            count_range(*[listed[c].to_pylist() for c in ("size", "differences", "held")]), pa.binary())})

    answers = (blocks.mapInArrow(ask, "range int, block long, size int, differences binary, held binary")
               .groupBy("range").applyInArrow(answer, "block long, range int, classes binary"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("grp", pa.int64()),
                        ("single", pa.int32()), ("tokens", pa.binary()), ("parity", pa.list_(pa.int64())), ("prefix", pa.binary())])

    def settle(key, held, told):
        ids, texts = unpack_block(held["ids"][0], held["packed"][0])
        parts = [c for _, c in sorted(zip(told["range"].to_pylist(), told["classes"].to_pylist()))]
        found = settle_block(ids, texts, np.frombuffer(b"".join(parts), np.uint8), words, bits, percent)
        return pa.table(found, schema=schema)

    return cut(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        settle, "doc_id long, n_shingles long, set_id binary, grp long, single int, tokens binary, parity array<long>, prefix binary"))


def postings(found: DataFrame, percent: int) -> DataFrame:
    """shingle, size_class, grp, n, single, place of every prefix shingle of every group (repeated for each block that has the group)."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, VERIFY_ROWS):
                group, n, single, prefix = [c.to_pylist() for c in batch.slice(at, VERIFY_ROWS).columns]
                lengths = np.array([len(p) // 8 for p in prefix])
                place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(single, lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b"".join(prefix), np.int64)), pa.array(np.repeat([size_class(x, percent) for x in n], lengths), pa.int32()),
                     *[pa.array(np.repeat(c, lengths), pa.int64()) for c in (group, n, single)], pa.array(place, pa.int64())],
                    names=["shingle", "size_class", "grp", "n", "single", "place"])

    return (found.filter("prefix IS NOT NULL").select("grp", "n_shingles", "single", "prefix")
            .mapInArrow(run, "shingle long, size_class int, grp long, n long, single long, place long"))


def may_link(percent: int, n, n2, *overlaps):
    """Whether sets of n and n2 shingles can link if they share no more than each of ``overlaps``."""
    fits = F.least(n, n2) * 100 >= F.greatest(n, n2) * percent
    for o in overlaps:
        fits &= F.coalesce(o * (100 + percent) >= (n + n2) * percent, F.lit(True))
    return fits


def parity_overlap(n, n2, bits, bits2):
    """What two sets share at most, by their parity bits (null where one has none)."""
    differ = sum((F.bit_count(bits[i].bitwiseXOR(bits2[i])) for i in range(PARITY_WORDS)), F.lit(0))
    return (n + n2 - differ) / 2


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of set ids whose whole sets are alike enough."""
    side = lambda c: sets.select(F.col("set_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("tokens").alias(f"tokens_{c}"))
    joined = (pairs.join(side("a"), "a").join(side("b"), "b").filter(may_link(percent, F.col("n_a"), F.col("n_b")))
              .select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, VERIFY_ROWS):
                piece = batch.slice(at, VERIFY_ROWS)
                keep = []
                for n_a, n_b, x, y in zip(*[c.to_pylist() for c in piece.columns[2:]]):
                    both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                    keep.append(100 * both >= percent * (n_a + n_b - both))
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([piece.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])

    return joined.mapInArrow(run, "a binary, b binary")


def open_pairs(posted: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """ga, gb: pairs of groups of a list, and groups with themselves, that hold
    members of different marks and may link. ``placed``: grp, mark (of its
    representative) and parity of every set."""
    span = placed.groupBy("grp").agg(F.min("mark").alias("low"), F.max("mark").alias("high"),
                                     F.when(F.count(F.lit(1)) == 1, F.first("parity")).alias("parity"))
    marked = posted.join(span.drop("parity"), "grp")
    torn = marked.groupBy("shingle").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l <> h").select("shingle")
    columns = ("grp", "n", "single", "place", "low", "high", "parity")
    lists = cut(marked.join(torn, "shingle", "left_semi").select("shingle", *columns[:-1]).distinct()
                .join(span.select("grp", "parity"), "grp").select("shingle", *columns))
    commonest = (lists.groupBy("shingle", "low").agg(F.count(F.lit(1)).alias("many"))
                 .groupBy("shingle").agg(F.max_by("low", "many").alias("main")))
    outside = (lists.join(commonest, "shingle").filter("low <> high OR low <> main")
               .select(F.col("shingle").alias("shingle2"), *[F.col(c).alias(c + "2") for c in columns]))
    one, two = ({c: F.col(c + x) for c in columns} for x in ("", "2"))
    after = F.least(one["n"] - one["place"], two["n"] - two["place"])
    shared = one["n"] + two["n"] - F.greatest(one["n"] + two["single"], two["n"] + one["single"])
    apart = (one["grp"] != two["grp"]) & ~((one["low"] == one["high"]) & (two["low"] == two["high"]) & (one["low"] == two["low"]))
    pairs = (lists.join(outside, (F.col("shingle") == F.col("shingle2")) & apart & may_link(
        percent, one["n"], two["n"], after, shared, parity_overlap(one["n"], two["n"], one["parity"], two["parity"])))
        .select(F.least("grp", "grp2").alias("ga"), F.greatest("grp", "grp2").alias("gb")))
    return pairs.union(span.filter("low <> high").select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))).distinct()


def expand(groups: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """a, b: the members of pairs of groups that have different marks and may link."""
    side = lambda g, c: placed.select(F.col("grp").alias(g), *[F.col(x).alias(x + c) for x in ("set_id", "mark", "n_shingles", "parity")])
    differ = (F.col("mark_a") != F.col("mark_b")) & ((F.col("ga") != F.col("gb")) | (F.col("set_id_a") < F.col("set_id_b")))
    n, n2 = F.col("n_shingles_a"), F.col("n_shingles_b")
    left, right = groups.join(side("ga", "_a"), "ga"), side("gx", "_b")
    fits = may_link(percent, n, n2, parity_overlap(n, n2, F.col("parity_a"), F.col("parity_b")))
    return (left.join(right, (F.col("gb") == F.col("gx")) & differ & fits)
            .select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b")).distinct())


def set_components(found: DataFrame, percent: int) -> DataFrame:
    """set_id, root of every set that links with another one."""
    sets = cut(found.filter("tokens IS NOT NULL").select("set_id", "grp", "n_shingles", "parity", "tokens").dropDuplicates(["set_id"]))
    posted = postings(found, percent)
    first = sets.groupBy("grp").agg(F.min("set_id").alias("first"))
    own = F.struct("single", "grp")
    leaders = (posted.groupBy("shingle", "size_class").agg(F.min(own).alias("l"), F.max(own).alias("last"))
               .filter("l <> last").select("shingle", "size_class", F.col("l.grp").alias("leader")))
    stars = posted.join(leaders, ["shingle", "size_class"]).filter("grp <> leader").select("leader", "grp").distinct()
    pairs = (stars.join(first.withColumnRenamed("first", "b"), "grp")
             .join(first.select(F.col("grp").alias("leader"), F.col("first").alias("a")), "leader").select("a", "b"))
    members = sets.join(first, "grp").filter("set_id <> first").select(F.col("first").alias("a"), F.col("set_id").alias("b"))
    links = cut(verify(pairs.union(members), sets, percent))
    reps = cut(reached(links))
    placed = cut(sets.select("set_id", "grp", "n_shingles", "parity").join(reps, "set_id", "left")
                 .withColumn("mark", F.xxhash64(F.coalesce("rep", "set_id"))))
    more = cut(verify(expand(open_pairs(posted, placed, percent), placed, percent), sets, percent))
    # What a representative stands for is linked, so the components are those of the representatives.
    side = lambda c: reps.select(F.col("set_id").alias(c), F.col("rep").alias("rep_" + c))
    edges = (links.union(more).join(side("a"), "a", "left").join(side("b"), "b", "left")
             .select(F.coalesce("rep_a", "a").alias("a"), F.coalesce("rep_b", "b").alias("b")))
    roots = components(edges, "a", "b")
    every = reps.union(more.select("a", "a")).union(more.select("b", "b")).groupBy("set_id").agg(F.min("rep").alias("rep"))
    return every.join(roots, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("root", "rep").alias("root"))


def reached(links: DataFrame, hops: int = 3) -> DataFrame:
    """set_id, rep: the smallest set that a linked set finds within so many
    links. Sets with one representative are linked, over one or more; that is
    all the exact step needs, and it leaves few nodes to the components."""
    both = cut(links.union(links.select("b", "a")).select(F.col("a").alias("set_id"), F.col("b").alias("other")).distinct())
    reps = both.groupBy("set_id").agg(F.least("set_id", F.min("other")).alias("rep"))
    for _ in range(hops - 1):
        told = both.join(reps.select(F.col("set_id").alias("other"), "rep"), "other")
        reps = told.groupBy("set_id").agg(F.min("rep").alias("rep"))
    return reps


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
                    block_least: int = BLOCK_LEAST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set) and
    component_id (the smallest id that links reach, its own included)."""
    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = settled_documents(rows, words, percent, block_least, range_rows)
    alone = found.filter("set_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = found.filter("set_id IS NOT NULL")
    least = linked.groupBy("set_id").agg(F.min("doc_id").alias("least"))
    rooted = (least.join(set_components(found, percent), "set_id", "left").select("set_id", "least", F.coalesce("root", "set_id").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set_id", "component_id")
    return alone.union(linked.join(named, "set_id").select("doc_id", "n_shingles", "component_id"))
