"""Language identification by cross-parsing: suffix automata of labelled text per language.

A text is parsed greedily into the longest phrases that occur in a language's labelled text;
the language that needs the fewest phrases, each weighed by the cost of pointing into that
text, wins. Phrases run across words. Letters are lower-cased, all else is one space, and the
automata read UTF-8 bytes, so that their alphabet is bounded whatever the script.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm.common import dealt_table, in_parts

#: The bound of the labelled sample: whole rows of a language, in the order of a hash of doc_id,
#: that come to at most SAMPLE_BYTES bytes of letters. Rows over ROW_BYTES are not drawn; where
#: a language has no others, its shortest row is taken, whole.
SAMPLE_BYTES = 32_000
ROW_BYTES = 8_000
#: Rows that are drawn at least, where there are as many.
LEAST_ROWS = 40
UNKNOWN = "und"
#: Bytes of text that a task parses at a time. A phrase ends at every SEGMENT bytes of a text in
#: any language, so the segments of all texts of a part are parsed side by side.
PART_BYTES = 1 << 20
SEGMENT = 256
#: Below this mean phrase length, in bytes, no learned language explains a text: its letters or
#: letter pairs hardly occur in any of them.
LEAST_PHRASE = 1.5


def held_out() -> F.Column:
    """True where crc32 of the doc_id as text leaves 2 modulo 4; null doc_ids are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the start."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        state = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = state
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(follow)
                follow.append(follow[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return follow


class Model:
    """Suffix automata of the languages' labelled text as one table, and the cost of a phrase.

    ``texts``: the sample of each language, of ``letters``. ``steps`` holds, for each state of
    each automaton, the state that each byte leads to, 0 where the text has no such phrase; the
    rows of the start states are empty, and ``first`` has what they lead to.
    """

    def __init__(self, texts: dict[str, bytes]):
        self.langs, self.texts = sorted(texts), texts
        used = sorted(set(b"".join(texts.values())))
        self.width = len(used) + 1
        self.column = np.zeros(256, np.uint8 if self.width < 256 else np.uint16)  # 0: in no text
        self.column[used] = np.arange(1, self.width)
        tables = [self._table(texts[k]) for k in self.langs]
        kind = np.uint16 if all(len(t) <= 1 << 16 for t in tables) else np.uint32
        self.base = np.cumsum([0, *(t.size for t in tables)])[:-1, None]
        self.first = np.array([t[0] for t in tables], kind).reshape(len(tables), self.width)
        for t in tables:
            t[0] = 0
        self.steps = np.concatenate([t.ravel() for t in tables]).astype(kind) if tables else np.empty(0, kind)
        self.cost = np.array([math.log2(max(2, len(texts[k]))) for k in self.langs])

    def _table(self, text: bytes) -> np.ndarray:
        follow = suffix_automaton(text)
        out = np.zeros((len(follow), self.width), np.uint32)
        for state, row in enumerate(follow):
            for c, to in row.items():
                out[state, self.column[c]] = to
        return out

    def phrases(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of the greedy cross-parsing of segments of ``data``: languages by segments.

        All take a step together, longest first, so that those still going are the first ones.
        A byte that no sample has is a phrase of its own.
        """
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        at = np.minimum(starts[order][None] + np.arange(longest)[:, None], max(0, len(data) - 1))
        columns = self.column[data][at]
        counts = np.zeros((len(self.langs), len(sizes)), np.int32)
        state = np.zeros((len(self.langs), len(sizes)), self.steps.dtype)
        going = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
        for step, n in enumerate(going.tolist()):
            byte = columns[step, :n]
            place = np.multiply(state[:, :n], self.width, dtype=np.int64)
            place += byte
            place += self.base
            further = self.steps.take(place)
            stopped = further == 0
            counts[:, :n] += stopped
            state[:, :n] = np.where(stopped, self.first[:, byte], further)
        out = np.empty_like(counts)
        out[:, order] = counts
        return out


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter of every code point, a space for what is no letter."""
    out = np.full(0x110000, 0x20, "<u4")
    for c in map(chr, range(0x110000)):
        if c.isalpha():
            low = c.lower()
            out[ord(c)] = ord(low) if len(low) == 1 else ord(c)
    return out


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' letters as bytes, and where each text starts and stops in them.

    A text is its runs of letters, with one space before, between and after them; without
    letters it is empty. Neighbours share the space between them.
    """
    points = _letters()[np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le"), "<u4")]
    space = points == 0x20
    kept = np.ones(len(points), bool)
    kept[1:] = ~(space[1:] & space[:-1])
    place = np.cumsum(kept) - 1
    points = points[kept]
    at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    last = np.cumsum(sizes + 1)  # the place of the space after each text
    first = last - sizes - 1
    starts, stops = at[place[first]], at[place[last] + 1]
    stops[place[first] == place[last]] = starts[place[first] == place[last]]
    return np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8), starts, stops


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """(language, score, mean phrase length) of each text."""
    data, starts, stops = letters([t or "" for t in texts])
    sizes = stops - starts
    if not model.langs or not sizes.any():
        return [(UNKNOWN, 0.0, 0.0)] * len(texts)
    parts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), parts)
    first = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
    counts = model.phrases(data, first, np.minimum(SEGMENT, stops[owner] - first))
    total = np.stack([np.bincount(owner, weights=c, minlength=len(texts)) for c in counts], axis=1)
    costs = total * model.cost
    best = costs.argmin(axis=1)
    rows = np.arange(len(texts))
    least = costs[rows, best]
    costs[rows, best] = np.inf
    second = costs.min(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.where(np.isinf(second), 1.0, second / (second + least))
        length = sizes / total[rows, best]
    return [(model.langs[k], float(s), float(m)) if n else (UNKNOWN, 0.0, 0.0) for k, s, m, n in zip(best.tolist(), score, length, sizes.tolist(), strict=True)]


def fit(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, row_bytes: int = ROW_BYTES) -> Model:
    """Learn from labelled rows that are not held out, ``sample_bytes`` of letters a language.

    The driver gets a row a language, and about twice the sample.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()
    )
    size = F.octet_length("text")
    short = size <= row_bytes
    stats = labelled.groupBy("lang").agg(F.min(size).alias("least"), F.count(F.when(short, 1)).alias("n"), F.sum(F.when(short, size)).alias("total")).collect()
    if not stats:
        return Model({})
    share = {r["lang"]: min(1.0, max(2 * sample_bytes / max(1, r["total"] or 0), LEAST_ROWS / max(1, r["n"]))) for r in stats}
    most = {r["lang"]: row_bytes if r["n"] else r["least"] for r in stats}
    of = lambda d: F.element_at(F.create_map(*[F.lit(x) for pair in d.items() for x in pair]), F.col("lang"))
    order = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    drawn = labelled.filter((size <= of(most)) & (order < of(share) * (1 << 30))).select("lang", "text", order.alias("order")).collect()
    texts: dict[str, bytes] = dict.fromkeys(share, b"")
    for r in sorted(drawn, key=lambda r: (r["order"], r["text"])):
        own = letters([r["text"]])[0].tobytes()
        held = texts[r["lang"]]
        if not held or len(held) + len(own) <= sample_bytes:
            texts[r["lang"]] = held + own if held.strip() else own
    return Model({k: t for k, t in texts.items() if t.strip()})


def _predicted(model: Model, batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, float, float]]]]:
    for part in in_parts(batch, column, PART_BYTES):
        yield part, predict(model, part.column(column).to_pylist())


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score, phrase_length``.

    Only the text decides: null, and texts without a letter, are ``und`` with score 0. The
    score is the runner-up's share of the two best costs (0.5: a tie, which goes to the first
    language code; 1: only one language was learned). Without labelled rows all are ``und``.
    Rows that repeat give a row each, long texts are parsed whole, extra columns are ignored,
    an empty table gives no rows.
    """
    model = model or fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    names = ["doc_id", "held_out", "lang_pred", "score", "phrase_length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, found in _predicted(sent.value, batch, 2):
                columns = zip(*found, strict=True)
                arrays = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, phrase_length double")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows in a learned language, with all their columns.

    Rejected: ``und``, and texts whose phrases are shorter than LEAST_PHRASE bytes on average.
    Rows that repeat are judged alike; an empty table gives no rows.
    """
    model = model or fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index("text")
            for b, found in _predicted(sent.value, batch, column):
                yield b.filter(pa.array([lang != UNKNOWN and size >= LEAST_PHRASE for lang, _, size in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(dealt_table(spark, sf_dir, "documents"))
