"""Model calls as Arrow-batched steps (O-M1 .. O-M4, O-M6).

A model is a plain Python callable; the client is built once per partition
(``factory``) and called on batches, never per row through a row UDF. Spark
decides how many partitions run; in a partition up to ``max_in_flight`` calls
are under way at a time (a service answers them side by side; the callable must
then be safe to call from several threads), replies come back in the rows'
order, starts can be paced, and a call that takes longer than ``deadline_s`` is a
failed call. Model output is non-deterministic: write it to a table before
anything reads it twice.
"""

from __future__ import annotations

import json
import re
import sys
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The per-partition functions below are shipped by value, so executors need
# neither this package installed nor the driver's import path.
register_pickle_by_value(sys.modules[__name__])

# Fixed values written for failures (same strings as the reference).
GENERATION_FAILED = "Generation failed"
DEFAULT_TEMPERATURES = (0.5, 0.9)
# Prompts are long: rows whose texts a task holds as Python strings at once (a call's rows at least).
ROWS = 256


def word_count_tagger(prompts: list[str], temperature: float = 0.0) -> list[str]:
    """Deterministic stand-in generator: one tag naming the number of
    whitespace-separated words of the whole prompt."""
    return [json.dumps([{"tag": f"words{len(p.split())}",
                         "explanation": f"sampled at {temperature}"}]) for p in prompts]


def small_batches(spark: SparkSession, rows: int = 1) -> None:
    """Bound the session's Arrow batches (``session.small_batches``; at least
    ``rows`` rows, so that no model call is cut)."""
    # Imported here: executors get this module by value and need no other one.
    from tagweave.session import small_batches as bound

    bound(spark, rows)


def _batches(pdf: pd.DataFrame, size: int):
    for i in range(0, len(pdf), size):
        yield pdf.iloc[i:i + size]


def _extended(df: DataFrame, *fields):
    """The schema of ``df`` and further fields, none of which may be there."""
    from pyspark.sql import types as T

    clash = {f.name.lower() for f in fields} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    return T.StructType([*df.schema.fields, *fields])


def _texts(batches: Iterator[pa.RecordBatch], at: int, batch_size: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches, in whole calls of ``batch_size`` rows, with the texts
    of column ``at`` (null: empty): a task turns one slice at a time into Python
    strings, and all other columns stay in Arrow as they came."""
    rows = max(ROWS // batch_size, 1) * batch_size
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            piece = batch.slice(start, rows)
            yield piece, ["" if t is None else t for t in piece.column(at).to_pylist()]


class _Call(threading.Thread):
    """One call under way. A daemon: a call that never ends does not keep the worker."""

    def __init__(self, work: Callable, item):
        super().__init__(daemon=True)
        self.work, self.item, self.value, self.error, self.began = work, item, None, None, time.monotonic()
        self.start()

    def run(self):
        try:
            self.value = self.work(self.item)
        except Exception as e:  # noqa: BLE001 - told to the caller
            self.error = e

    def outcome(self, deadline_s: float | None):
        self.join(None if deadline_s is None else max(0.0, self.began + deadline_s - time.monotonic()))
        if self.is_alive():
            return None, TimeoutError(f"no reply within {deadline_s:g} s")
        return self.value, self.error


def in_flight(work: Callable, items: Iterable, width: int = 1, pause_s: float = 0.0, deadline_s: float | None = None) -> Iterator[tuple]:
    """(value, error) of ``work(item)`` for every item, in the items' order. At
    most ``width`` calls are waited for at a time, starts are ``pause_s`` apart,
    and a call beyond its deadline is given up (its thread is left behind)."""
    under_way: deque[_Call] = deque()
    for n, item in enumerate(items):
        if n and pause_s:
            time.sleep(pause_s)
        if width == 1 and deadline_s is None:
            try:
                yield work(item), None
            except Exception as e:  # noqa: BLE001
                yield None, e
            continue
        if len(under_way) >= width:
            yield under_way.popleft().outcome(deadline_s)
        under_way.append(_Call(work, item))
    while under_way:
        yield under_way.popleft().outcome(deadline_s)


def generate(df: DataFrame, text_col: str, factory: Callable[[], Callable] = lambda: word_count_tagger,
             batch_size: int = 8, out: str = "raw_response", max_in_flight: int = 1, pause_s: float = 0.0,
             deadline_s: float | None = None) -> DataFrame:
    """O-M1: one model output per row. A failing batch writes
    'Generation failed' for each of its rows (those rows are still parsed
    and scored, as in the reference) and records the cause in
    ``generation_error``; outputs are stripped."""
    from pyspark.sql import types as T

    schema, at = _extended(df, T.StructField(out, T.StringType()), T.StructField("generation_error", T.StringType())), df.columns.index(text_col)
    small_batches(df.sparkSession, batch_size)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, outs, errs, done = factory(), deque(), [], [], 0

        def calls():
            for piece, texts in _texts(it, at, batch_size):
                asked = [texts[i:i + batch_size] for i in range(0, len(texts), batch_size)]
                held.append((piece, asked))
                yield from asked

        call = lambda prompts: [str(r or "").strip() for r in model(prompts)][:len(prompts)]
        for res, e in in_flight(call, calls(), max_in_flight, pause_s, deadline_s):
            piece, asked = held[0]
            n, done = len(asked[done]), done + 1
            if e is None:
                short = n - len(res)  # a reply list shorter than the batch
                outs += res + [GENERATION_FAILED] * short
                errs += [None] * len(res) + ["no output for this prompt"] * short
            else:  # the batch alone fails, as in the reference
                outs += [GENERATION_FAILED] * n
                errs += [f"{type(e).__name__}: {e}"] * n
            if done == len(asked):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(outs, pa.string()), pa.array(errs, pa.string())], names=schema.fieldNames())
                held.popleft()
                outs, errs, done = [], [], 0

    return df.mapInArrow(run, schema)


RESPONSES_DDL = ("array<struct<response_id:int,temperature:double,text:string,"
                 "error:string,generated_at:string>>")


def sample_responses(df: DataFrame, text_col: str, factory: Callable[[], Callable] = lambda: word_count_tagger,
                     temperatures=DEFAULT_TEMPERATURES, batch_size: int = 8, pause_s: float = 0.0,
                     max_in_flight: int = 1, deadline_s: float | None = None) -> DataFrame:
    """O-M2 + O-M3: n responses per prompt, one per temperature, ids 1..n,
    kept in an array on the same row (no explode / regroup shuffle). A failed
    call gives text '' and an error for that response only."""
    from pyspark.sql import types as T

    schema, at = _extended(df, T.StructField("responses", T.ArrayType(T.StructType([
        T.StructField("response_id", T.IntegerType()), T.StructField("temperature", T.DoubleType()),
        T.StructField("text", T.StringType()), T.StructField("error", T.StringType()),
        T.StructField("generated_at", T.StringType())])))), df.columns.index(text_col)
    small_batches(df.sparkSession, batch_size)
    temperatures = list(temperatures)
    arrow = pa.list_(pa.struct([("response_id", pa.int32()), ("temperature", pa.float64()), ("text", pa.string()),
                                ("error", pa.string()), ("generated_at", pa.string())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, done = factory(), deque(), 0

        def filled(piece, per_row):
            return pa.RecordBatch.from_arrays([*piece.columns, pa.array(per_row, arrow)], names=schema.fieldNames())

        def calls():
            for piece, texts in _texts(it, at, batch_size):
                asked = [(texts[start:start + batch_size], start, i, t) for start in range(0, len(texts), batch_size) for i, t in enumerate(temperatures)]
                held.append((piece, asked, [[] for _ in texts]))
                yield from asked

        def call(ask):
            stamp = datetime.now(timezone.utc).isoformat()
            return stamp, [str(x or "") for x in model(ask[0], ask[3])]

        if not temperatures:  # no calls: no responses
            yield from (filled(piece, [[] for _ in texts]) for piece, texts in _texts(it, at, batch_size))
        for reply, e in in_flight(call, calls(), max_in_flight, pause_s, deadline_s):
            piece, asked, per_row = held[0]
            (texts, start, i, t), done = asked[done], done + 1
            stamp, found = reply or (datetime.now(timezone.utc).isoformat(), [])
            missing = f"{type(e).__name__}: {e}" if e else "no output for this prompt"
            for j in range(len(texts)):
                there = j < len(found)
                per_row[start + j].append({"response_id": i + 1, "temperature": float(t), "text": found[j] if there else "",
                                           "error": None if there else missing, "generated_at": stamp})
            if done == len(asked):
                yield filled(piece, per_row)
                held.popleft()
                done = 0

    return df.mapInArrow(run, schema)


def generation_records(df: DataFrame, original, prompt: str, model: str, responses: str = "responses",
                       index: str = "index", keep: tuple[str, ...] = ()) -> DataFrame:
    """O-M3: generation records: the tagging prompt, the input row as JSON
    (``original``: a column that holds it, or the columns to make it of), the
    responses, and metadata with the time of processing; a row all of whose
    calls failed keeps ``index``, ``error``, ``original_data`` and the columns
    of ``keep`` only."""
    r = F.col(responses)
    failed = (F.size(r) > 0) & F.forall(r, lambda x: x["error"].isNotNull())
    fine = lambda c: F.when(~failed, c)
    source = F.col(original) if isinstance(original, str) else F.to_json(F.struct(*original))
    return df.select(
        *keep, F.col(index).alias("index"), source.alias("original_data"),
        fine(F.col(prompt)).alias("tagging_prompt"), fine(r).alias("responses"),
        fine(F.struct(F.lit(model).alias("model"), F.size(r).alias("n_responses"),
                      F.transform(r, lambda x: x["temperature"]).alias("temperatures"),
                      F.array_max(F.transform(r, lambda x: x["generated_at"])).alias("processed_at"))).alias("metadata"),
        F.when(failed, F.get(r, 0)["error"]).alias("error"))


JUDGEMENT_COLUMNS = ("chosen int, reasoning string, q1 double, d1 double, p1 double, "
                     "q2 double, d2 double, p2 double, annotation string")


def judge_pairs(df: DataFrame, factory: Callable[[], Callable], prompt: str = "prompt",
                r1: str = "response1", r2: str = "response2", max_retries: int = 3, backoff_s: float = 1.0,
                max_in_flight: int = 1, pause_s: float = 0.0, deadline_s: float | None = None) -> DataFrame:
    """O-M4: call a pairwise judge per row with retries (back-off 1 s, 2 s, ...).
    The judge returns the reply dict (chosen, reasoning, scores.response1/2
    .quality/diversity/privacy), which ``annotation`` keeps whole as JSON;
    after the last failure the columns are NULL and the judge step counts the
    row as failed. A deadline holds for a row's tries together."""
    from pyspark.sql import types as T

    small_batches(df.sparkSession)
    extra = T._parse_datatype_string(JUDGEMENT_COLUMNS)
    schema = T.StructType(df.schema.fields + extra.fields)

    def call(judge, p, a, b):
        for attempt in range(max_retries):
            try:
                return judge(p, a, b)
            except Exception:  # noqa: BLE001
                if attempt < max_retries - 1:
                    time.sleep(backoff_s * (2 ** attempt))
        return None

    def flat(reply):
        if not isinstance(reply, dict):
            return [None] * 9
        s = inner(reply, "scores")
        one, two = inner(s, "response1"), inner(s, "response2")
        chosen, reasoning = number(reply.get("chosen")), reply.get("reasoning")
        return [int(chosen) if chosen in (1.0, 2.0) else None, None if reasoning is None else str(reasoning),
                *[number(part.get(k)) for part in (one, two) for k in ("quality", "diversity", "privacy")],
                json.dumps(reply, ensure_ascii=False, default=str)]

    def inner(part, key):
        found = part.get(key)
        return found if isinstance(found, dict) else {}

    def number(value):
        """A reply's field as a number; anything else is a missing score."""
        try:
            return None if isinstance(value, bool) else float(value)
        except (TypeError, ValueError):
            return None

    names = [f.name for f in extra.fields]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = factory()
        for pdf in it:
            asked = in_flight(lambda pair: call(judge, *pair), zip(pdf[prompt], pdf[r1], pdf[r2]), max_in_flight, pause_s, deadline_s)
            rows = [flat(reply) for reply, _ in asked]
            cols = pd.DataFrame(rows, columns=names, index=pdf.index, dtype=object)
            cols["chosen"] = cols["chosen"].astype("Int32")
            cols[names[2:-1]] = cols[names[2:-1]].astype("float64")
            yield pd.concat([pdf, cols], axis=1)

    return df.mapInPandas(run, schema)


def text_judge(factory: Callable[[], Callable], template: str) -> Callable[[], Callable]:
    """A judge for ``judge_pairs`` from a model that answers prompts: the
    judge template is filled with the query and both answers, and the reply's
    JSON object is the judgement. A reply without one is a failed call."""
    def build():
        model = factory()

        def judge(query, first, second):
            fields = {"query": query or "", "first": first or "", "second": second or ""}
            reply = model([re.sub(r"\{(\w+)\}", lambda m: fields[m[1]], template)])[0]
            return json.loads(reply[reply.index("{"):reply.rindex("}") + 1])

        return judge

    return build


def embed_tags(tags: DataFrame, factory: Callable[[], Callable], batch_size: int = 64, max_in_flight: int = 1,
               deadline_s: float | None = None) -> DataFrame:
    """O-M6: embed each distinct tag once (the caller passes distinct tags), in
    batches, unit-normalised: (tag, vec ARRAY<DOUBLE>). The tags of a batch that
    fails, or has another number of vectors, get NULL vectors: names without one
    score 0."""
    import numpy as np

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()

        def encode(names):
            m = np.asarray(model(names), dtype="float64")
            if m.ndim != 2 or len(m) != len(names):
                raise ValueError(f"{m.shape} vectors for {len(names)} tags")
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return list(np.divide(m, norm, out=np.zeros_like(m), where=norm > 0))

        for pdf in it:
            asked = [b["tag"].tolist() for b in _batches(pdf, batch_size)]
            vecs = []
            for names, (made, e) in zip(asked, in_flight(encode, asked, max_in_flight, 0.0, deadline_s)):
                vecs += made if e is None else [None] * len(names)
            yield pd.DataFrame({"tag": pdf["tag"].values, "vec": vecs})

    return tags.select("tag").mapInPandas(run, "tag string, vec array<double>")


def cached_vectors(embed: Callable[[DataFrame], DataFrame], path: str, encoder: str) -> Callable[[DataFrame], DataFrame]:
    """O-J3: ``embed`` behind a table of vectors that outlives the run: Parquet
    under ``path/encoder=<encoder>``. Only tags without a vector there are
    encoded (an anti join on the tag column alone), and what comes back is
    appended; tags whose batch failed are not kept and are encoded again by the
    next run. Two runs at a time may both append a tag; readers take one."""
    # Imported here: executors get this module by value and need no other one.
    from tagweave.session import checkpoint_dir, path_exists

    folder = f"{path.rstrip('/')}/encoder={quote(encoder, safe=' -_.~@+,()')}"

    def run(tags: DataFrame) -> DataFrame:
        spark = tags.sparkSession
        checkpoint_dir(spark)
        wanted = tags.select("tag").where("tag IS NOT NULL").distinct().checkpoint(eager=True)
        schema = "tag string, vec array<double>"
        held = spark.read.schema(schema).parquet(folder) if path_exists(spark, folder) else spark.createDataFrame([], schema)
        made = embed(wanted.join(held.select("tag"), "tag", "left_anti")).select("tag", "vec").checkpoint(eager=True)
        found = held.join(wanted, "tag", "left_semi").dropDuplicates(["tag"]).unionByName(made).checkpoint(eager=True)
        made.where("vec IS NOT NULL").write.mode("append").parquet(folder)
        return found

    return run


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Stand-in encoder: character-trigram hashing into ``dim`` buckets."""
    import zlib

    def enc(texts):
        out = []
        for t in texts:
            v = [0.0] * dim
            s = f"  {t.lower()}  "
            for i in range(len(s) - 2):
                v[zlib.crc32(s[i:i + 3].encode()) % dim] += 1.0
            out.append(v)
        return out

    return enc


def responses_from_table(df: DataFrame, responses: DataFrame, key: str, text_col: str = "raw_response") -> DataFrame:
    """O-M1 default: take model outputs from an existing table by key (left
    join; a missing output is a failed generation)."""
    j = df.join(responses.select(key, F.col(text_col)), key, "left")
    return (j.withColumn("generation_error", F.when(F.col(text_col).isNull(), F.lit("missing output")))
            .withColumn(text_col, F.coalesce(F.col(text_col), F.lit(GENERATION_FAILED))))
