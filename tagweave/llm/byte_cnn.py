"""Quality classifier: a byte-level convolutional network in numpy.

A filter is a table of one weight per byte value and tap; at every byte of a
text each filter adds up the weights of the ``taps`` bytes from there on. The
text is covered by overlapping chunks from its first byte to its last; within
a chunk each filter's rectified response is max-pooled. The greatest and the
mean of a text's chunk responses go through one logistic unit to a
probability.

Training fits all weights by gradient descent on a bounded sample of labelled
documents, drawn by hash: about ``max_docs`` of them, fewer where those hold more than
``max_bytes`` bytes (the first one drawn is taken in any case). Of a drawn document
every chunk is learned from. The fitted weights are a few thousand numbers.
Scoring reads every byte of every text.

Cases: a null text counts as empty; an empty text is scored as padding; labels
that are null or belong to no document are not learned from, repeated labels of a
document count once (the smallest); with no labels, or one value only, the
score is the smoothed share of label 1; texts of any length are worked
through in segments of bounded size; a column that has the name of the result
is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.sizing import bounded_broadcast
from tagweave.llm.common import cut, map_rows

TAPS = 6
FILTERS = 16
CHUNK, STRIDE = 512, 384
MAX_DOCS = 2000
MAX_BYTES = 16 << 20
EPOCHS = 12
THRESHOLD = 0.3
SEED = 11
# Bytes of a text worked through at once, and chunks in training.
SEGMENT = STRIDE * 256
STEP_CHUNKS = 256


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the overlapping chunks that cover n bytes."""
    return np.arange(max(1, -(-(n - (CHUNK - STRIDE)) // STRIDE))) * STRIDE


def to_bytes(text: str | None) -> np.ndarray:
    """The text's bytes, padded with zeros to the length of a filter."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return np.concatenate([raw, np.zeros(TAPS - len(raw), np.uint8)]) if len(raw) < TAPS else raw


def responses(raw: np.ndarray, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Response of every filter at every place: (places, filters)."""
    places = len(raw) - TAPS + 1
    out = tables[0][raw[:places]]
    for tap in range(1, TAPS):
        out += tables[tap][raw[tap:tap + places]]
    return out + bias


def pooled(raw: np.ndarray, model: dict) -> np.ndarray:
    """Greatest and mean of the chunks' pooled responses."""
    starts = chunk_starts(len(raw))
    most, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS)
    for at in range(0, len(starts), SEGMENT // STRIDE):
        own = starts[at:at + SEGMENT // STRIDE]
        part = responses(raw[own[0]:own[-1] + CHUNK], model["tables"], model["bias"])
        begin = np.minimum(own - own[0], len(part) - 1)  # a last chunk may be shorter than a filter
        end = np.minimum(begin + CHUNK - TAPS + 1, len(part))
        bounds = np.stack([begin, end], axis=1).ravel()
        if bounds[-1] == len(part):
            bounds = bounds[:-1]
        chunks = np.maximum(np.maximum.reduceat(part, bounds, axis=0)[::2], 0)
        most = np.maximum(most, chunks.max(axis=0))
        total += chunks.sum(axis=0)
    return np.concatenate([most, total / len(starts)])


def probability(features: np.ndarray, model: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ model["out"] + model["out_bias"], -30, 30)))


def constant(labels: np.ndarray) -> dict:
    share = (labels.sum() + 1) / (len(labels) + 2)
    return {"tables": np.zeros((TAPS, 256, FILTERS), np.float32), "bias": np.zeros(FILTERS, np.float32),
            "out": np.zeros(2 * FILTERS), "out_bias": float(np.log(share / (1 - share)))}


def peaks(raw: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chunks (chunks, bytes): where each filter responds most, and how much."""
    where, most = np.empty((len(raw), FILTERS), np.int64), np.empty((len(raw), FILTERS), np.float32)
    places = raw.shape[1] - TAPS + 1
    for at in range(0, len(raw), STEP_CHUNKS):
        own = raw[at:at + STEP_CHUNKS]
        act = tables[0][own[:, :places]]
        for tap in range(1, TAPS):
            act += tables[tap][own[:, tap:tap + places]]
        here = act.argmax(axis=1)
        where[at:at + STEP_CHUNKS], most[at:at + STEP_CHUNKS] = here, np.take_along_axis(act, here[:, None, :], 1)[:, 0]
    return where, most


def train(chunks: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Fit on the chunks of each document (chunks, bytes) and the labels."""
    if len(set(labels.tolist())) < 2:
        return constant(labels)
    rng = np.random.default_rng(seed)
    p = {"tables": rng.normal(0, 0.15, (TAPS, 256, FILTERS)).astype(np.float32), "bias": np.full(FILTERS, 0.1, np.float32),
         "out": rng.normal(0, 0.1, 2 * FILTERS), "out_bias": np.array(0.0)}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step, size = 0, 32
    filters = np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), size):
            docs = order[at:at + size]
            raw = np.concatenate([chunks[d] for d in docs])
            many = np.array([len(chunks[d]) for d in docs])
            begin = np.cumsum(many) - many
            where, peak = peaks(raw, p["tables"])
            peak = peak + p["bias"]
            live = np.maximum(peak, 0)
            most = np.maximum.reduceat(live, begin, axis=0)
            mean = np.add.reduceat(live, begin, axis=0) / many[:, None]
            features = np.concatenate([most, mean], axis=1)
            error = (probability(features, p) - labels[docs]) / len(docs)
            grad_features = error[:, None] * p["out"]
            of = np.repeat(np.arange(len(docs)), many)
            grad = (live == most[of]) * grad_features[of, :FILTERS] + (grad_features[:, FILTERS:] / many[:, None])[of]
            grad *= peak > 0
            g = {"tables": np.zeros_like(p["tables"]), "bias": grad.sum(axis=0), "out": features.T @ error + 1e-4 * p["out"], "out_bias": error.sum()}
            for tap in range(TAPS):
                byte = np.take_along_axis(raw, where + tap, 1)
                np.add.at(g["tables"][tap], (byte, filters[None, :]), grad)
            step += 1
            for k in p:  # Adam
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.01 * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return {"tables": p["tables"].astype(np.float32), "bias": p["bias"].astype(np.float32), "out": p["out"], "out_bias": float(p["out_bias"])}


def fit(df: DataFrame, labelled: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "label",
        max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> dict:
    """The network's weights. ``labelled`` has the columns ``doc`` and ``label`` (0 or 1)."""
    labels = (labelled.select(F.col(doc).alias("id"), F.col(label).cast("int").alias("y")).dropna()
              .groupBy("id").agg(F.min("y").alias("y")).withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)))
    share = min(1.0, max_docs / max(labels.count(), 1))
    drawn = bounded_broadcast(labels.filter(F.col("draw") < share).select("id", "y", "draw"), max_rows=2 * max_docs)
    texts = cut(df.select(F.col(doc).alias("id"), F.col(text).alias("text")).join(drawn, "id")
                .select("draw", "y", F.coalesce("text", F.lit("")).alias("text")).distinct())
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        first = texts.agg(F.min("draw")).first()[0]
        texts = texts.filter((F.col("draw") < share * max_bytes / size) | (F.col("draw") == first))
    sample = texts.orderBy("draw", "text").select("y", "text").toArrow()  # bounded by max_docs and max_bytes
    if not sample.num_rows:
        return constant(np.empty(0))
    return train([chunked(to_bytes(t)) for t in sample["text"].to_pylist()], sample["y"].to_numpy().astype(np.float64))


def chunked(raw: np.ndarray) -> np.ndarray:
    """All chunks of a text as rows, zeros after its end."""
    starts = chunk_starts(len(raw))
    padded = np.concatenate([raw, np.zeros(starts[-1] + CHUNK - len(raw) if starts[-1] + CHUNK > len(raw) else 0, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[starts]


def score(df: DataFrame, model: dict, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the probability of label 1 to every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # a few thousand weights
    at = df.columns.index(text)

    def start():
        model = sent.value

        def work(piece):
            features = np.array([pooled(to_bytes(t), model) for t in piece.column(at).to_pylist()])
            return [pa.array(probability(features, model))]

        return work

    return map_rows(df, [T.StructField(out, T.DoubleType())], start, keep=keep)
