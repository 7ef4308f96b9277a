"""Tag extraction from free model output (O-P8 .. O-P11), as JVM expressions.

The evaluation extractor tries, in order:
  1. the *last* non-greedy ``[...]`` match, parsed strictly; a list is final
     (items need both ``tag`` and ``explanation``);
  2. every ``{ ... "tag" ... "explanation" ... }`` object without nested
     braces, skipping ones that do not parse;
  3. a line scan where a line holding 'tag' and ':' starts a tag, a line
     holding 'explanation' and ':' fills it, otherwise the next non-empty
     line is the explanation;
  4. a fixed default tag when nothing was found.
The stage that produced the result is returned alongside the tags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions.jsonparse import has_key, is_object, let, strict_list, strict_value, variant_str
from tagweave.functions.text import _c, strip_ws
from tagweave.schemas import TAG_LIST_DDL

# Fixed values of the line fallback (must match the reference's output).
DEFAULT_TAG = "General"
DEFAULT_EXPLANATION = "Unable to parse"

# Fixed patterns of the evaluation extractor.
_LAST_LIST = r"(?s)\[.*?\]"
_OBJECT = r'\{[^{}]*"tag"[^{}]*"explanation"[^{}]*\}'


def _pair(tag: Column, explanation: Column) -> Column:
    return F.struct(tag.alias("tag"), explanation.alias("explanation"))


def _strip_quotes(c: Column) -> Column:
    return F.regexp_replace(c, "[\"']", "")


def _truthy(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _items_with_both_keys(arr: Column) -> Column:
    keep = F.filter(arr, lambda x: has_key(x, "tag") & has_key(x, "explanation"))
    return F.transform(keep, lambda x: _pair(strip_ws(variant_str(x, "tag")),
                                             strip_ws(variant_str(x, "explanation"))))


def line_fallback(text) -> Column:
    """Line scan (O-P9), in time linear in the text.

    Returns the tags found (possibly an empty list; the caller adds the
    default tag). Lines with "tag" and a colon cut the non-blank lines into
    segments, one tag each. A segment's explanation is what its last
    "explanation" line says or, where that is empty or there is none, the first
    other line after it that is not. Segments are cut by one split: stripped
    lines are not blank and hold no line break, so an empty line can stand
    before every tag line and nowhere else.
    """
    def says(line, word):
        return (F.instr(F.lower(line), word) > 0) & (F.instr(line, ":") > 0)

    def after(line):
        return _strip_quotes(strip_ws(F.substring(line, F.instr(line, ":") + 1, 1 << 30)))

    lines = F.filter(F.transform(F.split(_c(text), "\n", -1), strip_ws), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.when(says(x, "tag"), F.concat(F.lit("\n"), x)).otherwise(x))
    segments = F.split(F.concat(F.lit("\n"), F.array_join(marked, "\n")), "\n\n", -1)

    def pair(segment):
        return let(F.split(segment, "\n", -1), lambda own: let(
            F.coalesce(F.array_max(F.transform(own, lambda x, i: F.when((i > 0) & says(x, "explanation"), i))), F.lit(0)),
            lambda last: let(F.when(last > 0, after(F.get(own, last))), lambda said: _pair(
                after(F.get(own, 0)),
                F.when(_truthy(said), said).otherwise(F.get(F.filter(F.transform(F.slice(own, last + 2, F.lit(1 << 30)), _strip_quotes), _truthy), 0))))))

    return F.filter(F.transform(F.slice(segments, 2, 1 << 30), pair), lambda x: _truthy(x["tag"]) & _truthy(x["explanation"]))


def eval_stages(text) -> dict[str, Column]:
    """The intermediate values of the evaluation extractor, to be staged as
    columns (``last_list``, ``objects``, ``lines``) before ``eval_result``;
    ``score.parse_generated`` computes the later ones only where the earlier
    ones found nothing."""
    t = _c(text)
    last = F.try_element_at(F.regexp_extract_all(t, F.lit(_LAST_LIST), F.lit(0)), F.lit(-1))
    return {"last_list": strict_list(last),
            "objects": F.regexp_extract_all(t, F.lit(_OBJECT), F.lit(0)),
            "lines": line_fallback(t)}


def eval_result(text, last_list, objects, lines) -> Column:
    """STRUCT<tags, stage> from the staged intermediates (see eval_stages)."""
    t, lst, objs, lns = _c(text), _c(last_list), _c(objects), _c(lines)
    obj_vals = F.transform(objs, lambda m: strict_value(m))
    obj_tags = _items_with_both_keys(F.filter(obj_vals, lambda v: v.isNotNull() & is_object(v)))
    default = F.array(_pair(F.lit(DEFAULT_TAG), F.lit(DEFAULT_EXPLANATION)))
    empty = F.expr(f"cast(array() as {TAG_LIST_DDL})")
    tags = (F.when(t.isNull(), empty)
            .when(lst.isNotNull(), _items_with_both_keys(lst))
            .when(F.size(objs) > 0, obj_tags)
            .when(F.size(lns) > 0, lns)
            .otherwise(default))
    stage = (F.when(t.isNull(), "error")
             .when(lst.isNotNull(), "list")
             .when(F.size(objs) > 0, "object")
             .when(F.size(lns) > 0, "lines")
             .otherwise("default"))
    return F.struct(tags.alias("tags"), stage.alias("stage"))


def extract_tags_eval(text) -> Column:
    """Evaluation extractor (O-P8 + O-P9) as one expression: STRUCT<tags, stage>.

    stage is one of 'list', 'object', 'lines', 'default', or 'error' for a
    NULL text (which yields an empty list). Inside a DataFrame job prefer
    ``score.parse_generated``, which stages the intermediates as columns so
    that they are computed once per row.
    """
    st = eval_stages(text)
    return eval_result(text, st["last_list"], st["objects"], st["lines"])


def balanced_prefix(text) -> Column:
    """Text up to the point where the bracket depth first returns to zero,
    counting from the first character (O-P10 helper), or NULL.

    One fold over the brackets and the stretches between them keeps (depth,
    position, end); brackets inside strings are counted naively, like the
    reference does.
    """
    t = _c(text)
    pieces = F.regexp_extract_all(t, F.lit(r"[\[\]]|[^\[\]]+"), F.lit(0))
    state0 = F.expr("named_struct('depth', 0, 'at', 0, 'end', 0)")

    def step(acc, piece):
        depth = acc["depth"] + F.when(piece == "[", 1).when(piece == "]", -1).otherwise(0)
        at = acc["at"] + F.length(piece)
        return F.when(acc["end"] > 0, acc).otherwise(F.struct(
            depth.alias("depth"), at.alias("at"), F.when((piece == "]") & (depth == 0), at).otherwise(0).alias("end")))

    res = F.aggregate(pieces, state0, step)
    return let(res["end"], lambda end: F.when(end > 0, F.substring(t, F.lit(1), end)))


def tag_object_spans(text) -> Column:
    """Balanced ``{...}`` spans that start at ``{"tag":`` (O-P10 helper): one
    fold over the braces and the stretches between them keeps (depth,
    position, start, spans), so time grows with the text. Scanning resumes
    after each closed object; an object that never closes ends the scan.
    Braces inside strings are counted naively, like the reference does. Texts
    without the start are not scanned. Returns the span texts."""
    t = _c(text)
    pieces = F.regexp_extract_all(t, F.lit(r'\{"tag":|[{}]|[^{}]+'), F.lit(0))
    state0 = F.expr("named_struct('depth', 0, 'at', 0, 'start', 0, 'spans', cast(array() as array<struct<s:int,n:int>>))")

    def step(acc, piece):
        at = acc["at"] + F.length(piece)

        def state(depth, start, spans):
            return F.struct(depth.alias("depth"), at.alias("at"), start.alias("start"), spans.alias("spans"))

        outside = state(F.lit(0), F.lit(0), acc["spans"])
        closed = state(F.lit(0), F.lit(0), F.array_append(
            acc["spans"], F.struct((acc["start"] + 1).alias("s"), (at - acc["start"]).alias("n"))))
        opens = (piece == "{") | (piece == _TAG_OBJECT_START)
        return (F.when(acc["depth"] == 0, F.when(piece == _TAG_OBJECT_START, state(F.lit(1), acc["at"], acc["spans"])).otherwise(outside))
                .when(opens, state(acc["depth"] + 1, acc["start"], acc["spans"]))
                .when((piece == "}") & (acc["depth"] == 1), closed)
                .when(piece == "}", state(acc["depth"] - 1, acc["start"], acc["spans"]))
                .otherwise(state(acc["depth"], acc["start"], acc["spans"])))

    spans = F.transform(F.aggregate(pieces, state0, step)["spans"], lambda sp: F.substring(t, sp["s"], sp["n"]))
    return F.when(F.instr(t, _TAG_OBJECT_START) > 0, spans).otherwise(F.array().cast("array<string>"))


# Fixed patterns of the SFT extractor.
_SFT_OBJECT = r'(?s)\{"tag":\s*"([^"]+)",\s*"explanation":\s*"([^"]*?)"\}'
_TAG_OBJECT_START = '{"tag":'


def extract_tags_sft(text) -> Column:
    """SFT extractor (O-P10): ARRAY<STRUCT<tag, explanation>>.

    After stripping: text starting with '[' is parsed whole; if that fails,
    the balanced ``[...]`` prefix is parsed and a failure there gives an
    empty result; without a balanced prefix it falls through. Then the
    strict ``{"tag": "...", "explanation": "..."}`` pattern, then balanced
    objects starting at ``{"tag":`` parsed one by one, else empty. The stripped text, the prefix and the pattern matches are each
    bound once (``let``), so no step is evaluated twice.
    """
    empty = F.expr(f"cast(array() as {TAG_LIST_DDL})")

    def as_tags(arr):
        keep = F.filter(arr, lambda x: x.isNotNull() & is_object(x))
        return F.transform(keep, lambda x: _pair(F.try_variant_get(x, "$.tag", "string"),
                                                 F.try_variant_get(x, "$.explanation", "string")))

    def after_brackets(t):
        def objects(m):
            strict_objs = F.zip_with(m["names"], m["expls"], lambda a, b: _pair(a, b))
            scanned = F.transform(tag_object_spans(t), strict_value)
            return F.when(F.size(strict_objs) > 0, strict_objs).otherwise(as_tags(scanned))

        matches = F.struct(F.regexp_extract_all(t, F.lit(_SFT_OBJECT), F.lit(1)).alias("names"),
                           F.regexp_extract_all(t, F.lit(_SFT_OBJECT), F.lit(2)).alias("expls"))
        return let(matches, objects)

    def body(t):
        starts = t.startswith("[")
        whole = strict_list(t)
        bracket = let(balanced_prefix(t), lambda span: F.when(
            span.isNotNull(), F.coalesce(as_tags(strict_list(span)), empty)))
        return (F.when(t.isNull(), empty)
                .when(starts & whole.isNotNull(), as_tags(whole))
                .when(starts & bracket.isNotNull(), bracket)
                .otherwise(after_brackets(t)))

    return let(strip_ws(_c(text)), body)


def tag_names(arr) -> Column:
    """Tag names from a tag list (O-P11): struct tags that are not NULL.

    ``arr`` is ARRAY<STRUCT<tag, ...>>; elements without a tag are dropped,
    which compacts positions.
    """
    names = F.transform(_c(arr), lambda x: x["tag"])
    return F.filter(names, lambda x: x.isNotNull())
