"""Benchmark decontamination with DataFrame functions only: no Python runs on the executors.

Texts are lower-cased (A-Z) and cut into words of a-z, 0-9 and non-ASCII characters. A window is `k` consecutive words of
a benchmark item; an item of fewer words is one window, an item without words none. Any occurrence of a window of n words
covers a whole block of (n + 1) // 2 words that starts at a multiple of that length. So all blocks inside the windows are
hashed into a bitmap that every task holds, each document's aligned blocks are scanned against it, and the windows around
the few blocks that it lets through are joined with the benchmark's windows, which verifies the hit. The bitmap has
BITS_PER_BLOCK bits a block, from MIN_BITS to MAX_BITS; beyond that it lets more blocks through, with the same result. The
windows are broadcast only if they and their items take at most BROADCAST_BYTES, otherwise both sides are shuffled.
Null texts have no words and no hits; an empty benchmark hits nothing. Every row gives one row, repeated ones and ones of a
null id too. A shuffled window is salted, so that one that a third of all texts hold is spread over SALTS tasks.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_BLOCK = 16
MIN_BITS, MAX_BITS = 1 << 20, 1 << 24
BROADCAST_BYTES = 32 << 20
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = "".join(map(chr, (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))
# A word with the separators before it, and what follows the last word.
# Both begin where a gap begins and give nothing back, so long gaps take linear time.
GAP = r"(?<![\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+"
TOKEN = GAP + r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
TAIL = GAP + r"\z"


def words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + GAPS, LOWER + " " * len(GAPS))
    return F.array_remove(F.split(plain, " "), "")


def benchmark_windows(benchmark: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(len, window, items): each distinct window as its words joined by spaces, with the sorted ids of its items."""
    w = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0 AND item IS NOT NULL")
    size = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(size - (k - 1), F.lit(1)))
    w = w.select("item", F.least(size, F.lit(k)).alias("len"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, k), " "))).alias("window"))
    return w.groupBy("len", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def block_size(n: int) -> int:
    """Words of the aligned block that any run of n words covers."""
    return (n + 1) // 2


def _block_hashes(b: int) -> Column:
    count = F.floor(F.size("w") / b).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda m: F.xxhash64(F.slice("w", m * b + 1, b))))


def bitmap_bits(blocks: int) -> int:
    """Bits of the bitmap of so many blocks: a power of two."""
    return min(max(1 << (BITS_PER_BLOCK * blocks - 1).bit_length(), MIN_BITS), MAX_BITS)


def _candidates(n: int, bitmap: Column, bits: int) -> Column:
    """The windows of n words around the aligned blocks (hashes in column k<n>) that the bitmap of so many bits has."""
    b, size = block_size(n), F.size("w")

    def seen(m: Column) -> Column:
        key = F.element_at(f"k{n}", m + 1)
        lane = F.pmod(F.shiftright(key, 6), F.lit(bits // 64)).cast("int")
        return F.getbit(F.element_at(bitmap, lane + 1), key.bitwiseAND(F.lit(63)).cast("int")) == 1

    def around(m: Column) -> Column:
        first, last = F.greatest(m * b + b - n, F.lit(0)), F.least(m * b, size - n)
        return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))

    def made(i: Column) -> Column:
        return F.struct(i.alias("at"), F.lit(n).alias("len"), F.array_join(F.slice("w", i + 1, n), " ").alias("window"))

    blocks = F.filter(F.sequence(F.lit(0), F.greatest(F.size(f"k{n}") - 1, F.lit(0))), seen)
    starts = F.array_distinct(F.flatten(F.transform(blocks, around)))
    return F.when(size >= n, F.transform(starts, made)).otherwise(F.array().cast("array<struct<at:int,len:int,window:string>>"))


def hits(docs: DataFrame, benchmark: DataFrame, k: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id_col, n_words, hit: sorted positions of hit words, items: sorted ids of items with occurring windows)."""
    windows = benchmark_windows(benchmark, k, item_col)
    inside = F.expr("transform(sequence(1, len - (len + 1) div 2 + 1), i -> xxhash64(slice(split(window, ' '), cast(i as int), cast((len + 1) div 2 as int))))")
    held = F.octet_length("window") + F.octet_length(F.array_join(F.col("items").cast("array<string>"), ",")) + 16 * F.size("items") + 64
    sizes = windows.groupBy("len").agg(F.sum(F.size(inside)).alias("blocks"), F.sum(held.cast("long")).alias("held")).collect()  # k rows at most
    bits = {row.len: bitmap_bits(row.blocks) for row in sizes}
    found = {n: [0] * (size // 64) for n, size in bits.items()}
    if bits:
        mask = F.element_at(F.create_map(*(F.lit(x) for n, size in bits.items() for x in (n, size // 64))), F.col("len"))
        blocks = windows.select("len", F.explode(inside).alias("key")).select("len", F.pmod(F.shiftright("key", 6), mask).alias("lane"), F.col("key").bitwiseAND(F.lit(63)).alias("bit"))
        lanes = blocks.groupBy("len", "lane").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits"))
        for row in lanes.collect():  # at most k * MAX_BITS / 64 rows, whatever the benchmark
            found[row.len][row.lane] = row.bits
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("row"), words(F.col(text_col)).alias("w"))
    names = []
    for n in sorted(found):
        base = base.withColumn(f"k{n}", _block_hashes(block_size(n)))
        names.append(n)
    parts = [F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("len"), F.lit("").alias("window")))]
    parts += [_candidates(n, F.from_json(F.lit(json.dumps(found[n])), "array<bigint>"), bits[n]) for n in names]
    near = base.select("id", "h", "row", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(*parts)).alias("c")).select("id", "h", "row", "n_words", "c.*")
    if sum(row.held for row in sizes) <= BROADCAST_BYTES:
        met = near.join(F.broadcast(windows), ["len", "window"], "left")
    else:
        spread = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = near.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(spread.hint("merge"), ["len", "window", "salt"], "left")  # never broadcast by an estimate
    met = met.where("at = -1 OR items IS NOT NULL")
    spans = F.collect_list(F.when(F.col("at") >= 0, F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)))
    out = met.groupBy("id", "h", "row", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(spans))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return out.select(F.col("id").alias(id_col), "h", "n_words", "hit", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 8, max_items: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without benchmark passages: a document in which windows of more than `max_items` items occur is removed, from
    the others the hit words are cut out with the separators before them. Untouched rows stay as they are."""
    found = hits(docs, benchmark, k, id_col, text_col).where("size(hit) > 0").select(F.col(id_col).alias("__id"), F.col("h").alias("__h"), F.col("hit").alias("__hit"), F.size("items").alias("__items"))
    found = found.dropDuplicates(["__id", "__h"])
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__h")), "left").where(F.coalesce("__items", F.lit(0)) <= max_items)
    tokens = F.regexp_extract_all(text_col, F.lit(TOKEN), F.lit(0))
    left = F.array_join(F.filter(tokens, lambda _, i: ~F.array_contains("__hit", i)), "")
    cut = F.concat(left, F.regexp_extract(text_col, TAIL, 0))
    return joined.withColumn(text_col, F.when(F.col("__hit").isNotNull(), cut).otherwise(F.col(text_col))).select(*docs.columns)
