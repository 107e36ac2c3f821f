"""Token counts by rank-synchronous array merging for BPE piece models with byte fallback.

Distinct pre-tokens of a batch are held as one ragged numpy array of piece ids; in every round each sequence merges its
pair of the lowest rank (the leftmost of equals), all sequences at once, until none can merge. The surviving symbols are
counted: a known piece is one token, a symbol without a piece one token per UTF-8 byte.

Pre-tokens are exact cuts: no piece has a space mark after another character, and two neighbouring characters that stand
side by side in no piece never merge. A sequence longer than LONG symbols goes through a heap instead, with equal results.
Null and empty texts have 0 tokens. Every row gives one row, repeated ones and ones of a null id too; other columns are
dropped. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import chunks, tidy

MODEL = "piece_bpe_32k.model"
LONG = 256
CACHE = 400_000
NONE = np.int64(1) << 62


class PieceModel:
    """Pieces, scores and merges of a .model file whose normalisation is the identity."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces or spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback:
            raise ValueError("not a byte-fallback BPE model with identity normalisation")
        pieces = {p.piece.replace("▁", " "): (i, p.score) for i, p in enumerate(spec.pieces) if p.type in (1, 4, 5)}
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("a piece has a space mark after another character")
        self.prefix = " " if spec.normalizer_spec.add_dummy_prefix else ""
        self.ids = {p: i for p, (i, _) in pieces.items()}
        order = {p: k for k, p in enumerate(sorted(pieces, key=lambda p: (-pieces[p][1], pieces[p][0])))}
        merges = sorted((self.ids[p[:j]] << 32 | self.ids[p[j:]], order[p], self.ids[p]) for p in pieces for j in range(1, len(p)) if p[:j] in pieces and p[j:] in pieces)
        self.pairs, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        self.merge = {pair: (rank, made) for pair, rank, made in merges}
        self.beside = {p[j : j + 2] for p in pieces for j in range(len(p) - 1)}
        self.split = re.compile(" *[^ \n]+| +|\n") if not any("\n" in p and len(p) > 1 for p in pieces) else re.compile(" *[^ ]+| +")
        self.cache: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        return self.split.findall(self.prefix + text.replace("▁", " ")) if text else []

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [self.pretokens(t or "") for t in texts]
        if len(self.cache) > CACHE:
            self.cache = {}
        new = list(set().union(*cut).difference(self.cache))
        self.cache.update(zip(new, self._survivors(new), strict=True))
        return [sum(map(self.cache.__getitem__, words)) for words in cut]

    def _survivors(self, words: list[str]) -> list[int]:
        out = np.zeros(len(words), np.int64)
        symbols: list[int] = []
        owner: list[int] = []
        sequence: list[int] = []
        k = 0
        ids, beside = self.ids, self.beside
        for w, word in enumerate(words):
            start = 0
            for j in range(1, len(word) + 1):
                if j < len(word) and word[j - 1 : j + 1] in beside:
                    continue
                part = word[start:j]
                start = j
                if len(part) == 1:
                    out[w] += 1 if part in ids else len(part.encode())
                elif part in ids and len(part) == 2:
                    out[w] += 1
                elif len(part) > LONG:
                    out[w] += self._heap(part)
                else:
                    symbols += [ids.get(c, -len(c.encode())) for c in part]
                    owner.append(w)
                    sequence += [k] * len(part)
                    k += 1
        if symbols:
            np.add.at(out, owner, self._merge_all(np.array(symbols, np.int64), np.array(sequence, np.int64), k))
        return out.tolist()

    def _merge_all(self, sym: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
        counts = np.zeros(n, np.int64)
        while len(sym):
            key = np.where((sym[:-1] >= 0) & (sym[1:] >= 0) & (seq[:-1] == seq[1:]), sym[:-1] << 32 | np.maximum(sym[1:], 0), -1)
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[at] == key
            rank = np.where(hit, self.ranks[at] << 32 | np.arange(len(key)), NONE)
            rank = np.append(rank, NONE)
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(rank, first)
            alive = best < NONE
            left = (best[alive] & 0xFFFFFFFF).astype(np.int64)
            sym[left] = self.made[at[left]]
            keep = np.repeat(alive, np.diff(np.append(first, len(sym))))
            done = ~keep
            if done.any():
                counts += np.bincount(seq[done], np.where(sym[done] >= 0, 1, -sym[done]), n).astype(np.int64)
            keep[left + 1] = False
            sym, seq = sym[keep], seq[keep]
        return counts

    def _heap(self, part: str) -> int:
        sym: list = [self.ids.get(c, -len(c.encode())) for c in part]
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(sym) and sym[i] >= 0 and sym[j] >= 0 and (m := self.merge.get(sym[i] << 32 | sym[j])):
                heapq.heappush(heap, (m[0], i, j, sym[i], sym[j], m[1]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b, made = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], sym[j] = made, None
            after[i] = after[j]
            if after[i] < len(sym):
                before[after[i]] = i
            offer(before[i], i), offer(i, after[i])
        return sum(1 if s >= 0 else -s for s in sym if s is not None)


@functools.cache
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, model_path: str | None = None) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row of docs; one pass, no shuffle."""
    path = model_path or public_tokenizers.path(MODEL)

    def run(batches):
        model = load_model(path)
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(model.count(batch.column("text").to_pylist()), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = texts.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(tidy(run), "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
