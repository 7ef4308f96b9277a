"""LM scoring with a weighted backoff automaton over word n-grams.

The model is an n-gram model with additive unigrams and Dirichlet smoothing
above them: P(w | ctx) = (c(ctx w) + mu P(w | ctx')) / (c(ctx) + mu), where
ctx' drops the oldest word of ctx. As an automaton: every context seen in
training is a state, every seen n-gram an arc with its smoothed weight, and
each state has a failure arc, weight mu / (c(ctx) + mu), to the state of ctx';
the empty state takes unknown words. Scoring walks each text once from left to
right, carries the state and adds up log10 weights.

Counts cover the whole corpus and no part of it is ever held in one place.
Documents are dealt into blocks by hash. A block lists its distinct n-grams as
sorted 64-bit hashes with its own training counts, sliced by hash range into
buckets; a bucket adds up its n-grams over all blocks (a frequent n-gram is one
entry per block there, however often it occurs) and answers every block in the
block's own order, so an answer is one small number per n-gram. A block's
automaton is built from its answers, holds only what its texts can reach, and
is gone with its task. Block and bucket sizes are parameters; their numbers
grow with the corpus.

Word hashes are 64 bits; n-grams above single words travel with as many bits
as the corpus needs for the chance of a wrong match to stay below one in a
million per n-gram.

Cases: a null text counts as empty and consists of the end token; a null id
counts as the empty string for the fold; with no training document every count
is zero and only unknown words are left; repeated rows count and score each;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import cut, map_rows, parallelism

ORDER = 2
MU = 100.0
ADD = 0.5
# UTF-8 bytes of text in a block, and n-grams in a bucket, about.
BLOCK_BYTES = 16 << 20
BUCKET_ROWS = 2 << 20
# Texts hashed at once.
HASH_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
END, START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def extend(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of the n-gram: context, then word."""
    return mix(context * np.uint64(0xD6E8FEB86659FD93) + word)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, BASE_INV, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, an end token after each, and the
    number of tokens of each text. Hashes are polynomials over the bytes of a
    word, taken from one running sum over the batch."""
    out, counts = [], []
    part: list[bytes] = []

    def flush():
        joined = np.frombuffer(b" ".join([*part, b""]), np.uint8)
        lengths = np.array([len(p) + 1 for p in part])
        space = _SPACE[joined]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
        starts, ends = edge[0::2], edge[1::2]
        up, down = _powers(len(joined))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[joined] * up, dtype=np.uint64)])
        words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        n = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)])))
        made = np.full(len(words) + len(part), END)
        at = np.ones(len(made), bool)
        at[np.cumsum(n + 1) - 1] = False
        made[at] = words
        out.append(made)
        counts.append(n + 1)
        part.clear()

    size = 0
    for text in texts:
        part.append(text.lower())  # of bytes: A-Z only
        size += len(part[-1]) + 1
        if size >= HASH_BYTES:
            flush()
            size = 0
    if part:
        flush()
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(counts)


def grams(words: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length 1..order: the hash of the n-gram that ends at each token, and
    whether the text is long enough for it (a start symbol goes before it)."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    made = [(words, np.ones(len(words), bool))]
    for n in range(2, order + 1):
        before = np.empty_like(words)
        before[1:] = made[-1][0][:-1]
        if n == 2:
            before[place == 0] = START
            there = np.ones(len(words), bool)
        else:
            # the context of the first token is the start symbol alone; longer ones need more tokens before
            there = place >= n - 2
            first = place == n - 3
            before[first] = 0
        made.append((extend(before, words), there))
    return made


def distinct_grams(texts: list[bytes], training: np.ndarray, order: int):
    """The numbers of tokens of the texts, and per length a table: the sorted
    distinct hashes, their training counts, a token position that shows each
    (START: -1) and, for each token, the place of the n-gram that ends there
    (-1: none)."""
    words, counts = tokens(texts)
    learned = np.repeat(training, counts)
    tables = []
    for n, (h, there) in enumerate(grams(words, counts, order), 1):
        at = np.flatnonzero(there)
        keys, first, inverse = np.unique(h[at], return_index=True, return_inverse=True)
        held = np.bincount(inverse[learned[at]], minlength=len(keys))
        first, place = at[first], np.full(len(words), -1, np.int32)
        place[at] = inverse
        if n == 1 and len(counts):
            spot = np.searchsorted(keys, START)
            keys, first = np.insert(keys, spot, START), np.insert(first, spot, -1)
            held = np.insert(held, spot, int(training.sum()))
            place[place >= spot] += 1
        tables.append((keys, held, first, place))
    return counts, tables


def pack(values: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned type that holds them all."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.min_scalar_type(top)).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}") if n else np.empty(0, np.uint8)


def pack_keys(keys: np.ndarray, drop_bits: int, width: int) -> bytes:
    """The ``width`` bytes below the top ``drop_bits`` bits of each hash."""
    kept = (keys << np.uint64(drop_bits)) >> np.uint64(64 - 8 * width)
    return np.ascontiguousarray(kept.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return full.view("<u8").ravel()


def bucket_edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2^bits hash ranges begins in the sorted hashes, and their end."""
    bounds = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.concatenate([np.searchsorted(keys, bounds), [len(keys)]])


def list_block(block: int, texts: list[bytes], training: np.ndarray, order: int, bits: int, widths: list[int]) -> list[tuple]:
    rows = []
    for n, (keys, held, _, _) in enumerate(distinct_grams(texts, training, order)[1], 1):
        edges = bucket_edges(keys, bits)
        for b in range(1 << bits):
            at = slice(edges[b], edges[b + 1])
            if edges[b] < edges[b + 1]:
                rows.append((b, block, n, int(edges[b + 1] - edges[b]), pack_keys(keys[at], bits, widths[n - 1]), pack(held[at])))
    return rows


def add_up(bucket: int, listed: list[tuple], bits: int, widths: list[int]) -> list[tuple]:
    """Answers (block, order, bucket, n, totals, tokens, types): each block's
    n-grams with their corpus totals; the bucket's training tokens and types
    stand in its first row."""
    answers, sizes = [], [0, 0]
    start = int(START) << bits & (1 << 64) - 1
    for order in sorted({r[2] for r in listed}):
        own = [r for r in listed if r[2] == order]
        keys = np.concatenate([unpack_keys(r[4], widths[order - 1]) for r in own])
        held = np.concatenate([unpack(r[5], r[3]) for r in own])
        types, inverse = np.unique(keys, return_inverse=True)
        totals = np.zeros(len(types), np.int64)
        np.add.at(totals, inverse, held.astype(np.int64))
        if order == 1:
            seen = totals > 0
            if bucket == int(START) >> 64 - bits if bits else True:
                seen &= types != np.uint64(start >> 64 - 8 * widths[0])
            sizes = [int(totals[seen].sum()), int(seen.sum())]
        at = 0
        for r in own:
            answers.append((r[1], order, bucket, r[3], pack(totals[inverse[at:at + r[3]]])))
            at += r[3]
    return [(*a, *(sizes if i == 0 else (0, 0))) for i, a in enumerate(answers)]


class Automaton:
    """States, arcs and failure arcs of the n-grams of one block.

    An arc is numbered by its n-gram's place in the block's table of that
    length, a state likewise by its words. ``arcs[k - 1]`` holds the log10
    weights of the k-grams' arcs (-inf: no such arc), ``fails[k - 1]`` those of
    the failure arcs of states with k words; both end with an entry for n-grams
    that the table does not have (place -1).
    """

    def __init__(self, counts: np.ndarray, tables: list, totals: list[np.ndarray], size: float, mu: float):
        self.keys = [t[0] for t in tables]
        self.order, self.unknown = len(tables), math.log10(ADD / size)
        self.start = int(np.searchsorted(self.keys[0], START)) if len(self.keys[0]) else -1
        self.arcs, self.fails = [], []
        begins = np.zeros(int(counts.sum()) + 1, bool)
        begins[(np.cumsum(counts) - counts)] = True
        for k, ((_, _, first, _), total) in enumerate(zip(tables, totals, strict=True), 1):
            total = total.astype(np.float64)
            seen = np.flatnonzero(total > 0)
            weight, fail = np.full(len(total) + 1, -np.inf), np.zeros(len(total) + 1)
            if k == 1:
                weight[seen] = np.log10((total[seen] + ADD) / size)
            else:
                at, shorter = first[seen], tables[k - 2][3]
                context = np.where(begins[at] if k == 2 else False, self.start, shorter[at - 1])
                weight[seen] = np.log10((total[seen] + mu * 10.0 ** self.arcs[-1][shorter[at]]) / (totals[k - 2][context] + mu))
            fail[seen] = np.log10(mu / (total[seen] + mu))
            self.arcs.append(weight)
            self.fails.append(fail)
        if self.start >= 0:
            self.starts, self.arcs[0][self.start] = totals[0][self.start] > 0, -np.inf  # a context, never a word

    def places(self, words: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """For any texts the places of the n-grams that end at each token."""
        out = []
        for keys, (h, there) in zip(self.keys, grams(words, counts, self.order), strict=True):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            out.append(np.where(there & (keys[at] == h), at, -1))
        return out

    def score(self, places: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        """log10 probability of every text, the texts walking side by side from
        left to right; ``length`` is the number of words of the state."""
        by_length = np.argsort(-counts, kind="stable")
        begin, left = (np.cumsum(counts) - counts)[by_length], counts[by_length]
        total = np.zeros(len(counts))
        n_left = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), side="right") if len(left) else []
        length = np.full(len(counts), int(self.order > 1 and self.start >= 0 and self.starts))
        for step, alive in enumerate(n_left):
            token = begin[:alive] + step
            at, now, gained = length[:alive].copy(), np.full(alive, -1), np.zeros(alive)
            for k in range(self.order, 1, -1):
                here = np.flatnonzero((now < 0) & (at == k - 1))
                if not len(here):
                    continue
                weight = self.arcs[k - 1][places[k - 1][token[here]]]
                hit = weight > -np.inf
                state = places[k - 2][token[here] - 1] if step else self.start
                gained[here] += np.where(hit, weight, self.fails[k - 2][state])
                now[here[hit]] = k
                at[here[~hit]] = k - 2  # along the failure arc
            here = np.flatnonzero(now < 0)
            weight = self.arcs[0][places[0][token[here]]]
            hit = weight > -np.inf
            gained[here] += np.where(hit, weight, self.unknown)
            now[here] = hit
            total[:alive] += gained
            length[:alive] = np.minimum(now, self.order - 1)
        out = np.empty(len(counts))
        out[by_length] = total
        return out


def score(df: DataFrame, training, doc: str = "doc_id", text: str = "text", order: int = ORDER, mu: float = MU,
          block_bytes: int = BLOCK_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: ``doc``, held_out, n_tokens, n_known,
    train_tokens, base_score (unigrams only) and score (the automaton's).

    ``training`` is a boolean column: the rows to learn from."""
    if order < 1:
        raise ValueError("order must be at least 1")
    rows = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    spark = df.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(parallelism(spark) if size > block_bytes else 1, math.ceil(size / block_bytes))
    bits = max(0, math.ceil(math.log2(max(1.0, size * order / 6 / bucket_rows))))
    wide = min(8, math.ceil((math.log2(size / 6 + 2) + 20 - bits) / 8))
    widths = [8] + [wide] * (order - 1)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n_blocks)).cast("int"))

    def pack_texts():
        press = zstandard.ZstdCompressor(level=3)
        return lambda piece: [pa.array([press.compress((t or "").encode()) for t in piece.column(1).to_pylist()], pa.binary())]

    # Texts are shuffled twice, compressed better than the shuffle would.
    blocks = map_rows(dealt, [T.StructField("packed", T.BinaryType())], pack_texts, keep=["doc_id", "training", "block"])

    def unpack_texts(held) -> list[bytes]:
        press = zstandard.ZstdDecompressor()
        return [press.decompress(t) for t in held["packed"].to_pylist()]

    def ask(key, held):
        listed = list_block(key[0].as_py(), unpack_texts(held), held["training"].to_numpy(), order, bits, widths)
        return pa.table(dict(zip(("bucket", "block", "n", "size", "keys", "held"), map(list, zip(*listed, strict=True)), strict=True)),
                        schema=asked_schema)

    asked_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("size", pa.int32()),
                              ("keys", pa.binary()), ("held", pa.binary())])
    asked = blocks.groupBy("block").applyInArrow(ask, "bucket int, block int, n int, size int, keys binary, held binary")

    def answer(key, listed):
        found = add_up(key[0].as_py(), list(zip(*[listed[c].to_pylist() for c in asked_schema.names], strict=True)), bits, widths)
        return pa.table(dict(zip(answer_schema.names, map(list, zip(*found, strict=True)), strict=True)), schema=answer_schema)

    answer_schema = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("bucket", pa.int32()), ("size", pa.int32()),
                               ("totals", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])
    answers = cut(asked.groupBy("bucket").applyInArrow(
        answer, "block int, n int, bucket int, size int, totals binary, tokens bigint, types bigint"))
    n_tokens, n_types = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("types")).first())
    mass = n_tokens + ADD * (n_types + 1)

    def walk(key, held, told):
        learn = held["training"].to_numpy()
        counts, tables = distinct_grams(unpack_texts(held), learn, order)
        parts: dict[int, list] = {}
        for n, bucket, many, totals in zip(*[told[c].to_pylist() for c in ("n", "bucket", "size", "totals")], strict=True):
            parts.setdefault(n, []).append((bucket, unpack(totals, many)))
        totals = [np.concatenate([t.astype(np.int64) for _, t in sorted(parts.get(n, []), key=lambda p: p[0])] or [np.empty(0, np.int64)])
                  for n in range(1, order + 1)]
        places = [t[3] for t in tables]
        known = totals[0][places[0]]
        begin = np.cumsum(counts) - counts
        model = Automaton(counts, tables, totals, mass, mu)
        return pa.table({
            "doc_id": held["doc_id"], "held_out": pa.array(~learn), "n_tokens": pa.array(counts.astype(np.int64)),
            "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), begin)),
            "train_tokens": pa.array(np.full(len(counts), n_tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(np.log10((known + ADD) / mass), begin)),
            "score": pa.array(model.score(places, counts))})

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return (blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        walk, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"))
