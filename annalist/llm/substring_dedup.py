"""Substring dedup over sliding runs of consecutive sentences.

A text is cut into sentences after words that end in . ! or ? and at line ends. Sentences of more than WINDOW words are
cut further, at word boundaries that their own words choose: of every WINDOW boundaries in a row inside a sentence, the
ones of the least hash of the two words around them. So no piece has more than WINDOW words, and whether a boundary is a
cut depends on nothing that is WINDOW words away, neither on the length of the sentence nor on the offset in the text.
From every piece starts, and at every piece ends, the shortest run of at least `span` pieces and `min_words` words; every
run is hashed (A-Z folded, white space as one space). In a passage of 50 words, wherever it is spliced in, the cuts from
the 8th to the 42nd boundary are its own; one is among the first eight of them, and a run from there ends within 25
words. So with span 2 and min_words 18 every repeat of 50 words holds a run, and a line of 17 words or fewer is none. The
runs of all texts meet by hash; the first occurrence is the one of the smallest (id, position). Pieces that any other
occurrence covers are removed, each with the white space before it (the first one with that after it). A text that loses
every piece becomes empty. Texts of fewer than `min_words` words lose nothing.

Null texts stay null and rows of a null id stay as they are (they neither take part nor lose anything, with n_removed 0).
Rows of equal id and text are one occurrence and are all cleaned alike. Other columns are kept; columns called n_sentences
or n_removed are replaced. White space is ASCII. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import chunks, tidy
from annalist.llm.jaccard_join import _pack, _unpack
from annalist.llm.shingles import mix, powers, word_spans

SPAN = 2
MIN_WORDS = 18
WINDOW = 8  # word boundaries in a row, inside a sentence, of which one at least is a cut
PART_ENTRIES = 600_000
BLOCK_ENTRIES = 400_000
RUN_BYTES = 16  # of text for each run, about
ENTRY = (np.int64, np.int64, np.int64, np.int32, np.int32)  # hash, id, tag, first and last piece
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def _slide(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of every WINDOW values in a row."""
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        x = pick(x[:-step], x[step:])
        width += step
    return x


class Pieces:
    """The pieces of all texts of an Arrow array: piece i has words start[i] to end[i], text t pieces first[t] to first[t + 1]."""

    def __init__(self, array: pa.Array):
        self.words, word, self.begins, self.ends, self.data, self.offsets = word_spans(array)
        n = len(self.words)
        stop = np.zeros(n, bool)  # a sentence ends after the word
        stop[word[1:][word[1:] > word[:-1]] - 1] = True
        if n:
            stop |= _STOP[self.data[self.ends - 1]]
            lines = np.concatenate(([0], np.cumsum(self.data == 10)))
            stop[:-1] |= lines[self.begins[1:]] > lines[self.ends[:-1]]
        cut = stop.copy()
        if n > WINDOW:
            h = mix(self.words[:-1] + (self.words[1:] << np.uint64(1))) | np.uint64(1)  # of the boundary after a word
            before = np.concatenate(([0], np.cumsum(stop)))
            least = _slide(h, np.minimum)
            least[before[WINDOW:n] != before[: n - WINDOW]] = 0  # windows that are not inside a sentence choose nothing
            around = np.zeros(n + WINDOW - 2, np.uint64)
            around[WINDOW - 1 : n - 1] = least
            cut[:-1] |= _slide(around, np.maximum) == h
        self.end = np.flatnonzero(cut) + 1
        self.start = np.concatenate(([0], self.end[:-1])) if len(self.end) else self.end
        self.first = np.searchsorted(self.start, word, "left")

    def runs(self, span: int = SPAN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, first piece, last piece) of every run, pieces counted from the text's first."""
        n = len(self.end)
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        every = np.arange(n)
        last = np.maximum(np.searchsorted(self.end, self.start + min_words, "left"), every + span - 1)
        first = np.minimum(np.searchsorted(self.start, self.end - min_words, "right") - 1, every - span + 1)
        a, b = last < self.first[owner + 1], first >= self.first[owner]
        pair = np.unique(np.concatenate((every[a] * (n + 1) + last[a], first[b] * (n + 1) + every[b])))
        first, last = pair // (n + 1), pair % (n + 1)
        up, down = powers(len(self.words) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.words * up[: len(self.words)], dtype=np.uint64)))
        begin, end = self.start[first], self.end[last]
        code = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)).view(np.int64)
        text = owner[first]
        return text, code, (first - self.first[text]).astype(np.int32), (last - self.first[text]).astype(np.int32)

    def text(self, t: int) -> list[bytes]:
        """Text t in parts that together are the text: the white space before its first piece, then each piece with the white
        space before it (the last one also with that after it)."""
        begin, stop = self.offsets[t], self.offsets[t + 1]
        own = slice(self.first[t], self.first[t + 1])
        if own.start == own.stop:
            return [self.data[begin:stop].tobytes()]
        bounds = [begin, self.begins[self.start[own.start]], *self.ends[self.end[own] - 1].tolist()[:-1], stop]
        return [self.data[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]

    def without(self, t: int, gone: set[int]) -> str:
        """Text t without these pieces."""
        lead, *pieces = self.text(t)
        kept = [p for k, p in enumerate(pieces) if k not in gone]
        if not kept:
            return ""
        if 0 in gone:
            kept[0] = kept[0].lstrip(b" \t\n\v\f\r")
        return (lead + b"".join(kept)).decode()


def sentences(text: str) -> list[str]:
    """The pieces of the text, in order; joined they are the text again."""
    lead, *pieces = Pieces(pa.array([text], pa.large_string())).text(0)
    return [p.decode() for p in ((lead + pieces[0], *pieces[1:]) if pieces else (lead,))]


def _split(blocks: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of blocks of entries (hash, id, tag, first, last): each hash's first occurrence, and the other occurrences."""
    columns = [np.concatenate(x) for x in zip(*blocks, strict=True)]
    blocks.clear()
    order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
    for j in range(len(columns)):
        columns[j] = columns[j][order]
    del order
    code = columns[0]
    head = np.append(True, code[1:] != code[:-1]) if len(code) else np.zeros(0, bool)
    own = (np.flatnonzero(head).astype(np.int32))[np.cumsum(head, dtype=np.int32) - 1]
    other = np.zeros(len(code), bool)
    for x in columns[1:4]:
        other |= x != x[own]
    return [x[head] for x in columns], [x[other] for x in columns]


def covered_runs(docs: DataFrame, span: int, min_words: int, parts: int) -> DataFrame:
    """(id, tag, first, last) of every run of docs (id, tag, text) that is not the first occurrence of its hash.

    Of the runs that a task holds at once, the occurrences after a hash's first one are covered whatever other tasks
    hold; only the first travels on, packed by part of the hash space. So a run that many texts share is one entry for each
    block of a task, and every run travels once.
    """

    def emit(pending: list):
        kept, covered = _split(pending)
        names, blobs = [], []
        part = (mix(kept[0].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((kept[3], kept[1], part))
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for i in range(parts):
            at = order[bounds[i] : bounds[i + 1]]
            if len(at):
                names.append(i), blobs.append(_pack(*(x[at] for x in kept)))
        if len(covered[0]):
            names.append(parts + int(covered[0][0]) % parts), blobs.append(_pack(*covered))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def local(batches):
        pending, size = [], 0
        for batch in chunks(batches, "text"):
            text, code, first, last = Pieces(batch.column("text")).runs(span, min_words)
            ids, tags = (batch.column(c).to_numpy()[text] for c in ("id", "tag"))
            pending.append((code, ids, tags, first, last))
            size += len(code)
            if size > BLOCK_ENTRIES:
                yield emit(pending)
                pending, size = [], 0
        if size:
            yield emit(pending)

    def collect(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.dtype(kind)) for kind in ENTRY]
        new, size = [], 0

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found[1:]], names=["id", "tag", "first", "last"])

        for batch in batches:
            for blob in batch.column("blob"):
                columns = _unpack(blob.as_py(), ENTRY)
                if key[0].as_py() >= parts:
                    yield rows(columns)
                    continue
                new.append(columns)
                size += len(columns[0])
                if size > max(len(held[0]), PART_ENTRIES // 4):
                    held, covered = _split([held, *new])
                    new, size = [], 0
                    yield rows(covered)
                    del covered
        if new:
            yield rows(_split([held, *new])[1])

    return docs.mapInArrow(tidy(local), "part int, blob binary").groupBy("part").applyInArrow(collect, "id long, tag long, first int, last int")


def clean(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cleaned, and n_sentences (pieces) and n_removed (longs)."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    covered = covered_runs(keyed, span, min_words, 1 + total // (PART_ENTRIES * RUN_BYTES))
    spans = covered.groupBy("id", "tag").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    base = docs.withColumn("__tag", F.xxhash64(text_col))
    spans = spans.select(F.col("id").alias("__id"), F.col("tag").alias("__other"), "spans")
    joined = base.join(spans, (F.col(id_col) == F.col("__id")) & (F.col("__tag") == F.col("__other")), "left")
    cols = [c for c in docs.columns if c not in (text_col, "n_sentences", "n_removed")]
    ready = joined.select(*cols, F.col(text_col).cast("string").alias("__text"), F.col("spans.first").alias("__first"), F.col("spans.last").alias("__last"))
    out = ready.select(*cols, F.col("__text").alias(text_col), F.lit(0).cast("long").alias("n_sentences"), F.lit(0).cast("long").alias("n_removed")).schema

    def cut(batches):
        for batch in chunks(batches, "__text"):
            pieces = Pieces(batch.column("__text"))
            gone = [{k for a, b in zip(x or (), y or (), strict=True) for k in range(a, b + 1)} for x, y in zip(batch.column("__first").to_pylist(), batch.column("__last").to_pylist(), strict=True)]
            texts = [pieces.without(t, g) if g else text for t, (text, g) in enumerate(zip(batch.column("__text").to_pylist(), gone, strict=True))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(texts, pa.string()), pa.array(np.diff(pieces.first), pa.int64()), pa.array(list(map(len, gone)), pa.int64())], names=out.names)

    return ready.mapInArrow(tidy(cut), out)
