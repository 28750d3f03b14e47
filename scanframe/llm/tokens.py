"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm.common import dealt_table, in_parts

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Bytes of text that are encoded at a time: batches are balanced by bytes, not by rows.
BATCH_BYTES = 8 << 20
#: Bytes of distinct chunks in one text that is handed to the library.
CALL_BYTES = 1 << 10


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Loaded:
    """A tokenizer, and how many bytes of text each of its ids stands for.

    ``widths`` is None where the ids of a text are not those of its chunks (see ``cuts``): that
    needs byte-level pieces and nothing that changes the text or adds to it.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not made.get("normalizer")
        plain = plain and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(_MARKS) for t in made.get("added_tokens", []))
        self.widths = None
        if plain:
            vocabulary = self.tokenizer.get_vocab()
            self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.widths[i] = len(token)  # a character stands for a byte

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Loaded:
    """The tokenizer of a file: one a worker process, not one a task."""
    return Loaded(path)


_MARKS = ".,;:!?"


def _among(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_WHITE, _VISIBLE, _MARK = _among(b" \t\n\x0b\x0c\r"), _among(bytes(range(0x21, 0x7F))), _among(_MARKS.encode())
_LETTER = _among(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)))


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the chunks of texts begin, in the bytes ``data`` of texts that begin at ``starts``.

    A chunk begins with a text, with white space after a visible character of ASCII or U+00C0
    to U+00FF, and with one of ``.,;:!?`` after a letter of ASCII. At these places the byte-level
    pre-tokenizer always ends a piece, whatever follows, and no special token holds them; so the
    ids of a text are those of its chunks, one after another.
    """
    if not len(data):
        return np.empty(0, np.int64)
    ends = _VISIBLE[data]
    ends[1:] |= data[:-1] == 0xC3  # leads U+00C0 to U+00FF
    begins = np.zeros(len(data), bool)
    begins[1:] = (_WHITE[data[1:]] & ends[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
    begins[starts[starts < len(data)]] = True
    return np.flatnonzero(begins)


class Chunks:
    """The distinct chunks of some texts, encoded once each, and the chunks of every text."""

    def __init__(self, model: Loaded, texts: pa.Array):
        column = texts.cast(pa.large_binary())
        offsets, data = _bounds(column)
        data, starts = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        begins = cuts(data, starts[:-1]) if model.widths is not None else np.unique(starts[:-1][starts[:-1] < len(data)])
        #: Chunks before each text, and the number of each chunk among the distinct ones.
        self.first = np.searchsorted(begins, starts)
        chunks = _strings(np.append(begins, len(data)), data)
        coded = chunks.dictionary_encode()
        self.number = coded.indices.to_numpy()
        self.starts, self.lengths, self.flat = _encoded(model, coded.dictionary)

    def counts(self) -> np.ndarray:
        """Tokens of each text."""
        total = np.concatenate([[0], np.cumsum(self.lengths[self.number])])
        return total[self.first[1:]] - total[self.first[:-1]]

    def ids(self) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            own = self.number[a:b]
            sizes = self.lengths[own]
            ends = np.cumsum(sizes)
            yield self.flat[np.repeat(self.starts[own] - (ends - sizes), sizes) + np.arange(ends[-1] if b > a else 0)]


def _strings(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _encoded(model: Loaded, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the ids of each distinct chunk start, how many they are, and all ids.

    Chunks that begin with white space and end in a visible character are handed over strung
    together, about CALL_BYTES a text, which is faster than one by one: between two of them a
    piece ends. The bytes that the ids stand for tell them apart again.
    """
    bounds, data = _bounds(distinct)
    strung = np.zeros(len(distinct), bool)
    if model.widths is not None and len(distinct):
        last = data[bounds[1:] - 1]
        lead = data[np.maximum(bounds[1:] - 2, bounds[:-1])]
        strung = _WHITE[data[bounds[:-1]]] & (_VISIBLE[last] | (lead == 0xC3))
    together, alone = np.flatnonzero(strung), np.flatnonzero(~strung)
    lengths = np.zeros(len(distinct), np.int64)
    flat = [np.empty(0, np.uint32)]
    if len(together):
        bounds, data = _bounds(distinct.take(pa.array(together)))
        calls = np.unique(np.append(np.searchsorted(bounds, np.arange(bounds[0], bounds[-1], CALL_BYTES)), len(bounds) - 1))
        edges = bounds[calls].tolist()
        flat += [np.array(ids, np.uint32) for ids in model.encode([str(data[a:b], "utf-8") for a, b in pairwise(edges)])]
        flat = [np.concatenate(flat)]
        reached = np.concatenate([[0], np.cumsum(model.widths[flat[0]])])
        at = np.searchsorted(reached, bounds - bounds[0])
        if (reached[at] != bounds - bounds[0]).any():
            raise ValueError("a token reaches over the end of a chunk")
        lengths[together] = np.diff(at)
    if len(alone):
        found = model.encode(distinct.take(pa.array(alone)).cast(pa.large_string()).to_pylist())
        lengths[alone] = [len(ids) for ids in found]
        flat += [np.array(ids, np.uint32) for ids in found]
    order = np.concatenate([together, alone])
    starts = np.empty(len(distinct), np.int64)
    starts[order] = np.cumsum(lengths[order]) - lengths[order]
    return starts, lengths, np.concatenate(flat)


def _bounds(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of the strings of an array in its bytes, and these."""
    bounds = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return bounds, np.frombuffer(strings.buffers()[2] or b"", np.uint8)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``path`` names the tokenizer file. Null and empty texts have no bytes and no tokens;
    repeated rows give repeated results; extra columns are ignored; an empty table gives no
    rows. Long texts are cut like all others, at safe boundaries (see ``cuts``); a stretch
    without one is encoded whole, however long.
    """
    path = path or tokenizer_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for b in in_parts(batch, 1, batch_bytes):
                counts = Chunks(model, b.column(1)).counts()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(dealt_table(spark, sf_dir, "documents"))
