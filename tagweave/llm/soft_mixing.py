"""Mixing to target weights with soft domain membership.

A classifier fitted on a labelled table gives every document a posterior over
domains. Every document then gets a nonnegative rate (how many copies of it the
mixture holds on average) so that the expected tokens of each domain, the sum
of rate x tokens x posterior, meet the target weights of a token budget.

The rates solve a least squares problem, one squared residual per domain in
units of the domain's tokens, by accelerated projected gradient steps. A step
needs one number per domain from the whole corpus: every task replays the few
steps so far on its own documents and returns partial sums. In the metric of
the documents' tokens the step length is 1 whatever the data, as the
posteriors of a document add up to one.

A floor under the rates keeps a domain that holds more than its share of the
budget above its target. Without ``epochs`` the budget therefore comes from the
data: it begins as the largest ratio of the tokens that a domain keeps at the
floor to its target, and where the steps end short of the targets (a document
added for one domain is also partly of others) it is raised to the largest
ratio reached, until the targets are met. Steps that end elsewhere warn, with
the weights reached.

The classifier is a multinomial logistic regression on the presence of learned
words and on shares of character classes, fitted on about ``max_docs``
labelled documents drawn by hash; the words are those whose document
frequencies differ most between domains in that sample.

``mix`` turns rates into whole copies: the integer part, and one more with the
probability of the rest, decided by the row's hash, so a retried task decides
alike.

Cases: a null or empty text has no tokens, its rate is 1 or the floor if that
is higher; a domain without tokens cannot be met and its target is spread over
the others; with no labelled document there is one domain and all rates are 1;
repeated rows get equal rates; labels of a document that disagree are taken as
the first domain in order; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.sizing import bounded_broadcast
from tagweave.llm.common import cut, free_name, map_rows, slices

MAX_DOCS = 4000
MAX_WORDS = 512
# Words rarer than this in the sample are not looked at.
MIN_DOCS = 5
STEPS = 60
TOLERANCE = 1e-4
# Difference of weights up to which targets count as met when totals stand still.
MET = 1e-3
# Times STEPS that the steps may go on while the budget is raised.
RAISES = 8
CLASSES = (rb"[A-Z]", rb"[a-z]", rb"[0-9]", rb"[\x20\x09-\x0D]", rb"[.,;:!?'\"()-]", rb"[\x80-\xff]", rb"[^\x00-\x20A-Za-z0-9.,;:!?'\"()\x80-\xff-]")
_CLASS_OF = np.zeros((256, len(CLASSES)), np.float64)
for _i, _pattern in enumerate(CLASSES):
    _CLASS_OF[[b for b in range(256) if re.fullmatch(_pattern, bytes([b]), re.DOTALL)], _i] = 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def features(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Presence of the vocabulary's words, then shares of the character classes."""
    out = np.zeros(len(vocabulary) + len(CLASSES))
    out[[vocabulary[w] for w in set(words_of(text)) & vocabulary.keys()]] = 1
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if len(raw):
        out[len(vocabulary):] = np.bincount(raw, minlength=256) @ _CLASS_OF / len(raw)
    return out


def posterior(x: np.ndarray, model: dict) -> np.ndarray:
    z = (x - model["mean"]) / model["scale"] @ model["weights"] + model["bias"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, n_domains: int, steps: int = 300, decay: float = 1e-3) -> dict:
    """Multinomial logistic regression by Adam on all rows at once."""
    model = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3, "weights": np.zeros((x.shape[1], n_domains)), "bias": np.zeros(n_domains)}
    target, scaled = np.eye(n_domains)[y], (x - model["mean"]) / (x.std(axis=0) + 1e-3)
    m = {k: [np.zeros_like(model[k]), np.zeros_like(model[k])] for k in ("weights", "bias")}
    for step in range(1, steps + 1):
        error = (posterior(x, model) - target) / len(x)
        for k, g in (("weights", scaled.T @ error + decay * model["weights"]), ("bias", error.sum(axis=0))):
            m[k][0] = 0.9 * m[k][0] + 0.1 * g
            m[k][1] = 0.999 * m[k][1] + 0.001 * g * g
            model[k] -= 0.02 * (m[k][0] / (1 - 0.9 ** step)) / (np.sqrt(m[k][1] / (1 - 0.999 ** step)) + 1e-8)
    return model


def fit(df: DataFrame, labelled: DataFrame, doc: str = "doc_id", text: str = "text", domain: str = "domain",
        max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> dict:
    """The classifier. ``labelled`` has the columns ``doc`` and ``domain``."""
    labels = (labelled.select(F.col(doc).alias("id"), F.col(domain).cast("string").alias("domain")).dropna()
              .groupBy("id").agg(F.min("domain").alias("domain"))
              .withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)))
    share = min(1.0, max_docs / max(labels.count(), 1))
    drawn = bounded_broadcast(labels.filter(F.col("draw") < share).select("id", "domain"), max_rows=2 * max_docs)
    sample = cut(df.select(F.col(doc).alias("id"), F.col(text).alias("text")).join(drawn, "id").select("domain", "text"))
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    domains = sorted(sizes)
    if not domains:
        return {"domains": ["all"], "vocabulary": {}}

    def seen(batches):
        for piece in slices(batches):
            rows = [(d, w) for d, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True) for w in set(words_of(t))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["domain", "word"])

    total = sum(sizes.values())
    rate = F.create_map(*[x for d in domains for x in (F.lit(d), F.lit(sizes[d] / total))])[F.col("domain")]
    per_domain = sample.mapInArrow(seen, "domain string, word binary").groupBy("word", "domain").agg(F.count(F.lit(1)).alias("n"))
    spread = (per_domain.withColumn("all", F.sum("n").over(_by_word())).filter(F.col("all") >= MIN_DOCS)
              .withColumn("part", F.pow(F.col("n") - F.col("all") * rate, F.lit(2)) / (F.col("all") * rate))
              .groupBy("word").agg(F.sum("part").alias("chi")).orderBy(F.desc("chi"), "word").limit(max_words).collect())
    vocabulary = {bytes(r["word"]): i for i, r in enumerate(spread)}
    width = len(vocabulary) + len(CLASSES)

    def measure(batches):
        for piece in slices(batches):
            yield pa.RecordBatch.from_pydict({"domain": piece.column(0), "x": [features(t, vocabulary).astype("<f4").tobytes() for t in piece.column(1).to_pylist()]})

    rows = sample.mapInArrow(measure, "domain string, x binary").toArrow().sort_by([("domain", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), "<f4").reshape(-1, width).astype(np.float64)
    y = np.array([domains.index(d) for d in rows["domain"].to_pylist()])
    return {"domains": domains, "vocabulary": vocabulary} | train(x, y, len(domains))


def _by_word():
    from pyspark.sql import Window

    return Window.partitionBy("word")  # as many rows as there are domains


def predict(df: DataFrame, model: dict, text: str = "text", tokens: str = "n_tokens", out: str = "posterior",
            keep: list[str] | None = None) -> DataFrame:
    """Add the number of words and the posterior over ``model['domains']``."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # max_words words and their weights
    at = df.columns.index(text)

    def start():
        model = sent.value

        def work(piece):
            texts = piece.column(at).to_pylist()
            if len(model["domains"]) == 1:
                p = np.ones((len(texts), 1))
            else:
                p = posterior(np.array([features(t, model["vocabulary"]) for t in texts]), model)
            return [pa.array([len(words_of(t)) for t in texts], pa.int64()), pa.array(list(p), pa.list_(pa.float64()))]

        return work

    return map_rows(df, [T.StructField(tokens, T.LongType()), T.StructField(out, T.ArrayType(T.DoubleType()))], start, keep=keep)


def replay(p: np.ndarray, gradients: list[np.ndarray], floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the projected steps, and the point that the next gradient is taken at."""
    rate = np.full(len(p), max(1.0, floor))
    ahead = rate.copy()
    for k, g in enumerate(gradients):
        new = np.maximum(ahead - p @ g, floor)
        ahead = new + k / (k + 3) * (new - rate)
        rate = new
    return rate, ahead


def solve(narrow: DataFrame, domains: list[str], targets: dict[str, float], floor: float = 0.0, epochs: float | None = 1.0,
          steps: int = STEPS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """The gradients of the projected steps. ``narrow`` has n_tokens and
    posterior; the budget is ``epochs`` times the tokens there are, or, if None,
    as large as the targets need. Under a floor and a given budget the targets
    may be out of reach: the steps then end, with a warning, at the least
    squares rates, when the domains' totals stand still. So they do where a
    larger budget brings the targets no nearer (a domain that has tokens and no
    target, or posteriors that do not tell domains apart)."""
    many = len(domains)

    def totals(gradients: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            sums = np.zeros((2, many))
            for batch in batches:
                t = batch.column(0).to_numpy().astype(np.float64)
                p = batch.column(1).flatten().to_numpy().reshape(-1, many)
                for i, r in enumerate(replay(p, gradients, floor)):
                    sums[i] += (r * t) @ p
            yield pa.RecordBatch.from_pydict({"s": [sums.ravel().tolist()]})

        parts = narrow.select("n_tokens", "posterior").mapInArrow(run, "s array<double>")
        row = parts.agg(*[F.sum(F.col("s")[i]) for i in range(2 * many)]).first()
        got = np.array([x or 0.0 for x in row])
        return got[:many], got[many:]

    held, _ = totals([])
    start = max(1.0, floor)
    have = held / start
    want = np.array([max(0.0, targets.get(d, 0.0)) for d in domains]) * (have > 0)
    if not want.sum():
        return []
    want /= want.sum()
    aims = want > 0
    budget = have.sum() * epochs if epochs is not None else max(have.sum(), (floor * have[aims] / want[aims]).max())
    unit = np.where(have > 0, have, 1.0)
    gradients: list[np.ndarray] = []
    before, last, settled = np.zeros(many), np.inf, None
    for _ in range(steps if epochs is not None else RAISES * steps):
        at, ahead = totals(gradients)
        off = np.abs(at / budget - want).max()
        if off <= tolerance:
            break
        if np.abs(at - before).max() <= tolerance * budget:
            if epochs is None and off > 0.9 * last:  # the last raise was in vain
                gradients, at = settled
                off = last
                break
            raised = (at[aims] / want[aims]).max()
            if epochs is not None or off <= MET or raised <= budget:
                break
            last, settled, budget = off, (list(gradients), at), raised
        before = at
        gradients.append((ahead - budget * want) / unit)
    if off > MET:
        reached = {d: round(float(x), 4) for d, x in zip(domains, at / max(at.sum(), 1e-300), strict=True)}
        warnings.warn(f"mixing ends at weights {reached}, not at the targets", stacklevel=2)
    return gradients


def rates(df: DataFrame, model: dict, targets: dict[str, float], doc: str = "doc_id", text: str = "text", floor: float = 0.0,
          epochs: float | None = 1.0) -> DataFrame:
    """One row per document: its id, n_tokens, domain (the likeliest), posterior and rate."""
    narrow = cut(predict(df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), model, keep=["doc_id"]))
    gradients = solve(narrow, model["domains"], targets, floor, epochs)
    domains = np.array(model["domains"], object)

    def start():
        def work(piece):
            p = np.array(piece.column(2).flatten().to_numpy()).reshape(-1, len(domains))
            rate = np.where(piece.column(1).to_numpy() > 0, replay(p, gradients, floor)[0], max(1.0, floor))
            return [pa.array(domains[p.argmax(axis=1)].tolist(), pa.string()), pa.array(rate)]

        return work

    return map_rows(narrow, [T.StructField("domain", T.StringType()), T.StructField("rate", T.DoubleType())], start, rows=8192)


def copies(rate, *key, seed: int = 17):
    """Whole copies of a row: the rate's integer part, and one more with the probability of the rest."""
    draw = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(df: DataFrame, model: dict, targets: dict[str, float], doc: str = "doc_id", text: str = "text", floor: float = 0.0,
        epochs: float | None = 1.0) -> DataFrame:
    """The mixture: every row of ``df`` as often as its rate says. The
    posteriors are computed once to solve for the rates and once more on the
    way through, so texts are not shuffled."""
    narrow = cut(predict(df.select(F.col(text).alias("text")), model, keep=[]))
    gradients = solve(narrow, model["domains"], targets, floor, epochs)
    n, p, r = (free_name(x, df) for x in ("__tokens", "__posterior", "__rate"))
    many = len(model["domains"])
    marked = predict(df, model, text, n, p)
    at = [marked.columns.index(x) for x in (n, p)]

    def start():
        def work(piece):
            post = np.array(piece.column(at[1]).flatten().to_numpy()).reshape(-1, many)
            return [pa.array(np.where(piece.column(at[0]).to_numpy() > 0, replay(post, gradients, floor)[0], max(1.0, floor)))]

        return work

    rated = map_rows(marked, [T.StructField(r, T.DoubleType())], start, keep=list(df.columns))
    times = copies(F.col(r), doc, text)
    return rated.filter(times > 0).withColumn(n, F.explode(F.array_repeat(F.lit(True), times))).select(*df.columns)
