"""Byte-level BPE encoding and decoding with the tiktoken library.

``encode`` adds the token ids of every whole text, ``decode`` turns ids back
into raw bytes, ``encode_decode`` does both in one pass. Ids are packed as
little-endian unsigned 32-bit integers, the usual layout of token files.

Long texts are cut only at safe boundaries: before white space that follows
another character. No match of the splitting pattern runs from a
non-space into white space and none looks behind itself, so both sides match
as they would in the whole text. A long run of white space is one match (all
of it at the end of the text, all but its last character before a word) and
is merged as one piece, because the regex engine's stack does not hold it.

Cases: a null text counts as empty and has no ids; an empty table gives an
empty table; repeated rows are encoded one by one; other columns pass through
(``encode_decode`` keeps the columns asked for). Null ids decode to empty
bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tagweave.llm.common import map_rows

# The characters that the pattern's \s matches.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_RUN = re.compile(f"[{WHITE}]{{256,}}")
SAFE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
# Characters after which a long text is cut at the next safe boundary.
CHUNK = 1 << 16


def read_ranks(path: str) -> bytes:
    """The rank file as it is, read on the driver and sent to the tasks."""
    with open(path, "rb") as f:
        return f.read()


def make_encoding(rank_file: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, chunk: int = CHUNK) -> Iterator[tuple[bool, str]]:
    """Parts of the text in order; True marks one that is a single match."""
    def chunks(at: int, end: int) -> Iterator[tuple[bool, str]]:
        while end - at > chunk:
            found = SAFE.search(text, at + chunk, end)
            if not found:
                break
            yield False, text[at:found.start()]
            at = found.start()
        if at < end:
            yield False, text[at:end]

    at = 0
    for run in LONG_RUN.finditer(text):
        yield from chunks(at, run.start())
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield True, text[run.start():at]
    yield from chunks(at, len(text))


def encode_text(encoding, text: str, chunk: int = CHUNK) -> np.ndarray:
    if len(text) <= chunk and not LONG_RUN.search(text):
        return encoding.encode_to_numpy(text, disallowed_special=())
    parts = [encoding._encode_single_piece(part) if whole else encoding.encode_to_numpy(part, disallowed_special=())
             for whole, part in pieces(text, chunk)]
    return np.concatenate([np.asarray(p, dtype=np.uint32) for p in parts]) if parts else np.empty(0, np.uint32)


def decode_ids(encoding, ids: np.ndarray) -> bytes:
    return encoding.decode_bytes(ids.tolist())


def _encoding_maker(spark: SparkSession, path: str, pattern: str) -> Callable:
    sent = spark.sparkContext.broadcast(read_ranks(path))  # a vocabulary file: its size does not follow the data
    return lambda: make_encoding(sent.value, pattern)


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the column ``ids`` (binary, little-endian uint32) to every row."""
    make, at = _encoding_maker(df.sparkSession, ranks, pattern), df.columns.index(text)

    def start():
        encoding = make()
        return lambda piece: [pa.array([encode_text(encoding, t or "").astype("<u4").tobytes()
                                        for t in piece.column(at).to_pylist()], pa.binary())]

    return map_rows(df, [T.StructField(ids, T.BinaryType())], start)


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the column ``decoded``: the raw bytes that the ids stand for."""
    make, at = _encoding_maker(df.sparkSession, ranks, pattern), df.columns.index(ids)

    def start():
        encoding = make()
        return lambda piece: [pa.array([decode_ids(encoding, np.frombuffer(i or b"", "<u4"))
                                        for i in piece.column(at).to_pylist()], pa.binary())]

    return map_rows(df, [T.StructField(decoded, T.BinaryType())], start)


def encode_decode(df: DataFrame, ranks: str, pattern: str, text: str = "text", keep: list[str] | None = None,
                  ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``ids`` and, from these alone, ``decoded``; ``keep`` names the columns kept."""
    make, at = _encoding_maker(df.sparkSession, ranks, pattern), df.columns.index(text)

    def start():
        encoding = make()

        def work(piece):
            coded = [encode_text(encoding, t or "") for t in piece.column(at).to_pylist()]
            return [pa.array([c.astype("<u4").tobytes() for c in coded], pa.binary()),
                    pa.array([decode_ids(encoding, c) for c in coded], pa.binary())]

        return work

    return map_rows(df, [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())], start, keep=keep)
