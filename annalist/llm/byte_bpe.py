"""Byte-level BPE encoding and decoding over a global shuffle of distinct pre-tokens.

`encode` cuts every text into pre-tokens, keeps their positions, encodes each distinct pre-token of the corpus once,
joins the ids back and puts them in order by position; `decode` joins the token-byte table.

Exploding every pre-token of every text to a row of its own would move several times the input, so positions are
pre-aggregated: a block of about `BLOCK` bytes of whole texts holds its distinct pre-tokens and, as a packed array, the
place of each position's pre-token among them. A block sends its distinct pre-tokens, dealt to parts by their hash, to the
task that encodes the distinct pre-tokens of that part, each once, and gets their ids back; its packed positions are
shuffled once. There is a part for each PART_BYTES of text, so a part's pre-tokens fit a task at any size. Decoding is a
map-side join: the token-byte table has as many rows as the vocabulary, whatever the corpus.
A null text counts as empty and gives no ids. Rows may repeat, and ids may be null; each row is encoded. Other columns are
dropped. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.llm.common import chunks, tidy

BLOCK = 8 << 20
PART_BYTES = 16 << 20
RANKS = "byte_bpe_50k.tiktoken"

_WIDE = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
# The same for texts below U+0250, where letters, numbers and white space are few ranges; `re` is faster there.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-ɏ]")


def pretokens(text: str) -> list[str]:
    return (_WIDE if _BEYOND.search(text) else _LATIN).findall(text)


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of the lowest rank merges first, the leftmost of equals first."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if best == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list, ranks: dict[bytes, int]) -> list[int]:
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [ranks[p] for p in parts if p is not None]


def _pack(numbers: np.ndarray) -> bytes:
    """The bytes of the numbers, plane by plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _row(block: int, part: int, payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([payload], pa.list_(pa.binary()))], names=["block", "part", "payload"])


ROW = "block long, part int, payload array<binary>"


def _blocks(parts: int):
    """For each block a row of part -1 (ids, pre-token counts, packed places) and a row of distinct pre-tokens per part.

    Places count the distinct pre-tokens part by part, in the order in which those rows hold them.
    """

    def rows(block, known, places, ids, sizes):
        words = list(known)
        part = np.array([zlib.crc32(w.encode()) % parts for w in words], np.int64)
        # Frequent pre-tokens first, so that their places are small numbers and pack well.
        flat = np.frombuffer(places, np.uint32)
        order = np.lexsort((-np.bincount(flat, minlength=len(words)), part))
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        known_id = np.array([x is not None for x in ids], np.uint8)
        yield _row(block, -1, [np.array([x or 0 for x in ids], np.int64).tobytes(), known_id.tobytes(), np.array(sizes, np.uint32).tobytes(), _pack(rank[flat])])
        own = part[order]
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist() if len(own) else []
        for a, b in zip(cut, [*cut[1:], len(own)], strict=False):
            mine = [words[i].encode() for i in order[a:b]]
            yield _row(block, int(own[a]), [zstandard.compress(np.array(list(map(len, mine)), np.uint32).tobytes(), 3), zstandard.compress(b"".join(mine), 3)])

    def run(batches):
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 32
        known, places, ids, sizes, total = {}, array("I"), [], [], 0
        for batch in chunks(batches, "text"):
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = pretokens(text or "")
                for word in set(found).difference(known):
                    known[word] = len(known)
                places.extend(map(known.__getitem__, found))
                ids.append(key), sizes.append(len(found))
                total += len(text or "")
                if total >= BLOCK:
                    yield from rows(block, known, places, ids, sizes)
                    block += 1
                    known, places, ids, sizes, total = {}, array("I"), [], [], 0
        if ids:
            yield from rows(block, known, places, ids, sizes)

    return run


def _only_words(batches):
    for batch in batches:
        yield batch.filter(pc.greater_equal(batch.column("part"), 0))


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: the bytes of every id."""
    table = [b""] * (max(load_ranks(path).values()) + 1)
    for token, rank in load_ranks(path).items():
        table[rank] = token
    return table


def _decoded(tokens: pa.Array, path: str) -> pa.Array:
    table = token_bytes(path)
    return pa.array([None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in tokens.to_pylist()], pa.binary())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, decoded: bool = False) -> DataFrame:
    """(id_col long, tokens binary): the token ids of each text as little-endian unsigned 32-bit integers.

    With `decoded` also the bytes that `decode` gives for these ids, made in the task that puts the ids together.
    """
    path = ranks_path or public_tokenizers.path(RANKS)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
    deal = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = texts.mapInArrow(tidy(_blocks(parts)), ROW).repartition(deal, "block")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, book = load_ranks(path), {}  # the part's distinct pre-tokens, each encoded once
        for batch in batches:
            for block, part, (lens, flat) in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "payload")), strict=True):
                ends = np.cumsum(np.frombuffer(zstandard.decompress(lens), np.uint32)).tolist()
                flat = zstandard.decompress(flat)
                codes, start = [], 0
                for end in ends:
                    word = flat[start:end]
                    start = end
                    code = book.get(word)
                    if code is None:
                        code = book[word] = np.array(merge_word(word, ranks), "<u4").tobytes()
                    codes.append(code)
                sizes = np.array([len(c) // 4 for c in codes], np.uint32)
                yield _row(block, part, [_pack(sizes), _pack(np.frombuffer(b"".join(codes), np.uint32))])

    # mapInArrow drops the position rows, not a filter, so that both uses of `blocks` read one and the same exchange.
    codes = blocks.mapInArrow(_only_words, ROW).groupBy("part").applyInArrow(tidy(run), ROW)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        head = [p for part, p in zip(left.column("part").to_pylist(), left.column("payload").to_pylist(), strict=True) if part < 0]
        if not head:
            return out_schema.empty_table()
        books = sorted(zip(right.column("part").to_pylist(), right.column("payload").to_pylist(), strict=True), key=lambda b: b[0])
        lens = np.concatenate([_unpack(b[0]) for _, b in books] or [np.zeros(0, np.uint32)]).astype(np.int64)
        flat = np.concatenate([_unpack(b[1]) for _, b in books] or [np.zeros(0, np.uint32)])
        starts = np.cumsum(lens) - lens
        (ids, known, sizes, places), at, out = head[0], 0, []
        places = _unpack(places)
        for size in np.frombuffer(sizes, np.uint32).tolist():
            own = places[at : at + size]
            at += size
            n = lens[own]
            index = np.arange(int(n.sum())) + np.repeat(starts[own] - (np.cumsum(n) - n), n)
            out.append(flat[index].astype("<u4").tobytes())
        columns = [pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(known, np.uint8) == 0), pa.array(out, pa.binary())]
        return pa.table([*columns, *([_decoded(columns[1], path)] if decoded else [])], schema=out_schema)

    out_schema = pa.schema([("id", pa.int64()), ("tokens", pa.binary()), *([("decoded", pa.binary())] if decoded else [])])
    made = blocks.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(assemble, "id long, tokens binary" + ", decoded binary" * decoded)
    return made.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, tokens_col: str = "tokens", ranks_path: str | None = None) -> DataFrame:
    """All columns and `decoded` binary: the bytes of the ids (null for null), joined with the token-byte table.

    The table has one entry per id of the vocabulary, whatever the corpus, so every task holds it; an unknown id is an error.
    """
    path = ranks_path or public_tokenizers.path(RANKS)
    out = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        for batch in chunks(batches, tokens_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch.column(tokens_col), path)], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(tidy(run), out)
