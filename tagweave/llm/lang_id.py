"""Language ID by interpolated Kneser-Ney character language models.

One model per language, all of one order. N-grams live in sorted arrays of
64-bit hashes, one array per order over all languages, with the interpolated
log probability in each language beside every hash (languages without the
n-gram hold their backed-off value); a second array per order holds the
contexts with their interpolation weights, for n-grams that no language has
seen. A text gets the language whose model gives the lowest cross-entropy per
character.

Rejection is calibrated on labelled texts kept out of the counts (an eighth of
those of a language that has at least ``CALIBRATE`` of them; a language with fewer
learns from all): a text is rejected if its cross-entropy exceeds the mean of its
predicted language by more than an allowance. That is half a nat and twice a high quantile of
what the language's calibration texts of that length class exceed it by, no
less than a value that falls with the root of the text's length; where a
language has few such texts, the quantile over all languages counts.

Only text and language are learned from. Every language that has a text has a
model. It is fitted on at most about ``per_language`` texts of each, drawn by
hash, and keeps all n-grams of the texts it learns from: these labelled rows
bound what reaches the driver and what is broadcast. Where they hold more
than ``max_ngrams`` n-grams, or more than ``max_cells`` numbers for all languages
together, the languages with the most learn from fewer texts, down to a single
one. Every text is scored whole.

Cases: null texts and texts without a letter are ``und`` with score 0 and
rejected; with nothing to learn from, every text is ``und``, with score 0, and
none but those is rejected; ties go to the first language in order; repeated
rows give equal rows; columns that have the names of the result are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import cut, map_rows, slices

ORDER = 4
PER_LANGUAGE = 2000
MAX_NGRAMS = 2_000_000
# Numbers of the models, n-grams times languages: the arrays' size in memory.
MAX_CELLS = 40_000_000
UNDETERMINED = "und"
# Texts of a language from which an eighth is kept for calibration, and calibration texts
# that a quantile takes; least letters of the length classes.
CALIBRATE = 40
ENOUGH = 30
CLASSES = (0, 64, 256, 1024)
QUANTILE, MARGIN, SLACK = 0.995, 2.0, 0.5
# Least allowance: nats per character, by the root of the number of letters and up to a length.
BY_ROOT, LONGEST = 8.0, 1024
SPACE = 32
# Powers of the multiplier of the n-gram hash.
POWERS = [np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64)) for k in range(16)]


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def normalise(text: str, letters: np.ndarray) -> tuple[np.ndarray, bool]:
    """Code points of the lower-cased text, everything but letters as single
    spaces, with a space at both ends; and whether there is a letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    is_letter = letters[codes]
    codes = np.where(is_letter, codes, np.uint32(SPACE))
    keep = np.ones(len(codes), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    return codes[keep], bool(is_letter.any())


def hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Per length 1..order the hash of the n-gram ending at each place (spaces before the first)."""
    c = np.concatenate([np.full(order - 1, SPACE, np.uint32), codes]).astype(np.uint64) + np.uint64(1)
    n, out = len(codes), []
    total = np.zeros(n, np.uint64)
    for k in range(order):
        total = total + c[order - 1 - k:order - 1 - k + n] * POWERS[k]
        out.append(total)
    return out


def gram_hash(grams: np.ndarray) -> np.ndarray:
    total = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        total = total + (grams[:, -1 - k].astype(np.uint64) + np.uint64(1)) * POWERS[k]
    return total


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys if len(table) else np.zeros(len(keys), bool))


def kneser_ney(by_language: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> dict:
    """Sorted hash arrays from each language's n-grams (rows of code points)
    and their counts."""
    languages = sorted(by_language)
    own: list[list] = [[] for _ in range(order + 1)]
    for grams, counts in (by_language[x] for x in languages):
        for k in range(order, 0, -1):
            own[k].append((grams, counts.astype(np.float64)))
            suffix = gram_hash(grams[:, 1:])
            _, first, types = np.unique(suffix, return_index=True, return_counts=True)
            grams, counts = grams[first, 1:], types  # continuation counts: different left neighbours
    alphabet = len(np.unique(np.concatenate([g[:, 0] for g, _ in own[1]]))) + 1
    model = {"languages": languages, "order": order, "floor": float(np.log(1 / alphabet)), "grams": [None], "logp": [None],
             "contexts": [None], "weights": [None]}
    lower = None
    for k in range(1, order + 1):
        rows = np.concatenate([g for g, _ in own[k]])
        keys, first = np.unique(gram_hash(rows), return_index=True)
        rows = rows[first]
        context = gram_hash(rows[:, :-1]) if k > 1 else np.zeros(len(rows), np.uint64)
        context_keys = np.unique(context)
        p, weight = np.zeros((len(keys), len(languages))), np.ones((len(context_keys), len(languages)))
        at_context = np.searchsorted(context_keys, context)
        for x, (grams, counts) in enumerate(own[k]):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
            mine = np.searchsorted(keys, gram_hash(grams))
            at = at_context[mine]
            total = np.bincount(at, counts, len(context_keys))
            types = np.bincount(at, minlength=len(context_keys))
            seen = total > 0
            weight[seen, x] = discount * types[seen] / total[seen]
            p[mine, x] = (counts - discount) / total[at]
        shorter = lower[1][np.searchsorted(lower[0], gram_hash(rows[:, 1:]))] if k > 1 else 1 / alphabet
        p += weight[at_context] * shorter
        lower = keys, p
        model["grams"].append(keys)
        model["logp"].append(np.log(p).astype(np.float32))
        model["contexts"].append(context_keys)
        model["weights"].append(np.log(weight).astype(np.float32))
    return model


def log_probabilities(model: dict, codes: np.ndarray) -> np.ndarray:
    """Natural log probability of each character in each language."""
    order, many = model["order"], len(model["languages"])
    h = hashes(codes, order)
    out = np.zeros((len(codes), many), np.float32)
    left = np.arange(len(codes))
    for k in range(order, 0, -1):
        at, hit = _lookup(model["grams"][k], h[k - 1][left])
        out[left[hit]] += model["logp"][k][at[hit]]
        left = left[~hit]
        if not len(left):
            break
        if k > 1:  # the context's hash is that of the n-gram one place before
            before = np.maximum(left - 1, 0)
            at, known = _lookup(model["contexts"][k], h[k - 2][before])
            known &= left > 0
            out[left[known]] += model["weights"][k][at[known]]
        else:
            out[left] += model["weights"][1][0] + model["floor"]
    return out


def entropies(model: dict, texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy of every text in every language (nats per character) and
    its number of characters, 0 if it has no letter."""
    many = len(model["languages"])
    codes = [normalise(t or "", letters) for t in texts]
    sizes = np.array([len(c) if has else 0 for c, has in codes])
    out = np.zeros((len(texts), many))
    group: list[int] = []

    def flush():
        if group:
            logp = log_probabilities(model, np.concatenate([codes[i][0] for i in group]))
            begin = np.cumsum([0, *(sizes[i] for i in group[:-1])])
            out[group] = -np.add.reduceat(logp, begin, axis=0, dtype=np.float64) / sizes[group][:, None]
            group.clear()

    held = 0
    for i in np.flatnonzero(sizes):
        group.append(int(i))
        held += sizes[i]
        if held >= 1 << 18:
            flush()
            held = 0
    flush()
    return out, sizes


def level(sizes: list[int], most: int) -> float:
    """The greatest share of each that keeps their sum within ``most``: smaller
    sizes stay whole and leave the rest to the others."""
    left = float(most)
    for i, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - i) > left:
            return left / (len(sizes) - i)
        left -= size
    return float("inf")


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc: str = "doc_id", order: int = ORDER,
        per_language: int = PER_LANGUAGE, max_ngrams: int = MAX_NGRAMS, max_cells: int = MAX_CELLS) -> dict:
    """The models of the languages in ``df``; ``doc`` only serves to draw the texts."""
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"),
                     F.xxhash64(doc, text).alias("draw")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("calibrate", F.pmod(F.shiftright("draw", 24), F.lit(8))).withColumn("draw", F.pmod("draw", F.lit(1 << 20)) / (1 << 20))
    # One row for each language; the text drawn first is always learned from.
    found = {r["lang"]: r for r in rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("draw", "calibrate")).alias("first")).collect()}
    if not found:
        return {"languages": []}
    shares = {x: min(1.0, per_language / r["n"]) for x, r in found.items()}

    def of_language(values: dict):
        return F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col("lang")]

    def within(shares: dict[str, float]):
        return (F.col("draw") < of_language(shares)) | (F.col("draw") == of_language({x: r["first"]["draw"] for x, r in found.items()}))

    # The eighth that the first text is in is learned from.
    apart = of_language({x: (r["first"]["calibrate"] + 1) % 8 if r["n"] >= CALIBRATE else -1 for x, r in found.items()})
    drawn = cut(rows.withColumn("calibrate", F.col("calibrate") == apart).filter(within(shares)))

    def count(batches):
        letters = letter_table()
        for piece in slices(batches):
            by_lang: dict[str, list[np.ndarray]] = {}
            for t, x in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                codes, has = normalise(t, letters)
                if has:
                    by_lang.setdefault(x, []).append(np.concatenate([np.full(order - 1, SPACE, np.uint32), codes]))
            for x, parts in by_lang.items():
                windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, order) for c in parts])
                _, first, n = np.unique(gram_hash(windows), return_index=True, return_counts=True)
                grams = windows[first].astype("<u4").tobytes().decode("utf-32-le", "replace")
                yield pa.RecordBatch.from_pydict({"lang": [x] * len(n), "gram": [grams[i:i + order] for i in range(0, len(grams), order)],
                                                  "n": n.astype(np.int64)})

    while True:
        counted = cut(drawn.filter("NOT calibrate").filter(within(shares)).select("text", "lang")
                      .mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
        sizes = {r["lang"]: r["count"] for r in counted.groupBy("lang").count().collect()}
        most = level(list(sizes.values()), min(max_ngrams, max_cells // max(1, len(sizes))))
        fewer = {x: shares[x] * 0.9 * most / n for x, n in sizes.items() if n > most and shares[x] * found[x]["n"] > 0.5}
        if not fewer:
            break
        shares |= fewer
    counted = counted.orderBy("lang", "gram").toArrow()
    if not counted.num_rows:
        return {"languages": []}
    codes = np.frombuffer("".join(counted["gram"].to_pylist()).encode("utf-32-le", "replace"), "<u4").reshape(-1, order)
    langs, n = np.array(counted["lang"].to_pylist(), object), counted["n"].to_numpy()
    model = kneser_ney({x: (codes[langs == x], n[langs == x]) for x in set(langs)}, order)
    model["allow"] = calibrated(annotate(drawn.filter("calibrate").select("lang", "text"), model, "text"), model["languages"])
    return model


def calibrated(tried: DataFrame, languages: list[str]) -> dict:
    """Mean cross-entropy of each language's calibration texts that it is
    predicted for, and what a text of each length class may exceed it by."""
    own = cut(tried.filter("lang = lang_pred").select("lang", "cross_entropy", "n_letters"))
    mean = {r["lang"]: r["m"] for r in own.groupBy("lang").agg(F.avg("cross_entropy").alias("m")).collect()}
    if not mean:
        return {"mean": [float("inf")] * len(languages), "over": [[float("inf")] * len(CLASSES)] * len(languages)}
    centre = F.create_map(*[x for k, v in mean.items() for x in (F.lit(k), F.lit(v))])[F.col("lang")]
    length = sum(((F.col("n_letters") >= c).cast("int") for c in CLASSES[1:]), F.lit(0))
    over = own.select("lang", length.alias("c"), (F.col("cross_entropy") - centre).alias("over"))
    high = F.percentile_approx("over", QUANTILE).alias("q"), F.count(F.lit(1)).alias("n")
    by_class = {r["c"]: r["q"] for r in over.groupBy("c").agg(*high).collect()}
    by_both = {(r["lang"], r["c"]): r["q"] for r in over.groupBy("lang", "c").agg(*high).collect() if r["n"] >= ENOUGH}
    allowed = []
    for x in languages:
        row, least = [], 0.0
        for c in reversed(range(len(CLASSES))):  # a shorter text is never allowed less
            q = by_both.get((x, c), by_class.get(c))
            least = max(least, MARGIN * max(q or 0.0, 0.0) + SLACK)
            row.append(least)
        allowed.append(row[::-1])
    # A language without calibration texts is measured by the least predictable one.
    return {"mean": [mean.get(x, max(mean.values())) for x in languages], "over": allowed}


def annotate(df: DataFrame, model: dict, text: str = "text", prefix: str = "") -> DataFrame:
    """Add lang_pred, score (posterior of texts of at most 50 characters, 0 to
    1), cross_entropy, n_letters and rejected to every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by max_ngrams and max_cells
    at = df.columns.index(text)
    names = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()),
             ("n_letters", T.LongType()), ("rejected", T.BooleanType())]

    def start():
        model, letters = sent.value, letter_table()
        languages = np.array([*model["languages"], UNDETERMINED], object)

        def work(piece):
            texts = piece.column(at).to_pylist()
            if not model["languages"]:
                sizes = np.array([normalise(t or "", letters)[1] for t in texts], np.int64)
                best, score, entropy = np.full(len(texts), len(languages) - 1), np.zeros(len(texts)), np.zeros(len(texts))
                rejected = sizes == 0
            else:
                ce, sizes = entropies(model, texts, letters)
                best, entropy = ce.argmin(axis=1), ce.min(axis=1)
                odds = np.exp(-(ce - entropy[:, None]) * np.minimum(sizes, 50)[:, None])
                score = np.where(sizes > 0, 1 / odds.sum(axis=1), 0.0)
                rejected = sizes == 0
                if model.get("allow"):
                    allow, few = model["allow"], np.minimum(np.maximum(sizes, 1), LONGEST)
                    over = np.array(allow["over"])[best, np.searchsorted(CLASSES, sizes, side="right").clip(1) - 1]
                    rejected |= entropy > np.array(allow["mean"])[best] + np.maximum(over, BY_ROOT / np.sqrt(few))
                best = np.where(sizes > 0, best, len(languages) - 1)
            return [pa.array(languages[best].tolist(), pa.string()), pa.array(score), pa.array(entropy),
                    pa.array(sizes.astype(np.int64)), pa.array(rejected)]

        return work

    return map_rows(df, [T.StructField(prefix + n, t) for n, t in names], start)
