"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

Texts are lower-cased (A-Z only) and cut into words at ASCII white space; a text's set holds its distinct `k`-word
shingles (fewer words: the whole sequence as one; no words or null: the empty set, linked with nothing). Two sets link
when their Jaccard similarity is at least `threshold` (a whole percentage, compared in integers).

How it runs at scale:
  1. One pass makes each text's shingles, and each range of their keys is counted by one task, so every shingle is ordered
     by its own count in the corpus, rarest first.
  2. Only the prefix that a partner must share is kept; shingles that one set alone has come first in the order, take
     up places and are left out.
  3. Equal sets are one class, so copies never multiply pairs. Entries travel packed, once. Where they meet, the sets of a
     key that few sets have are paired at once, and the entries of hot keys are passed on.
  4. Round one links every member of a hot key's group to the hub of its size band and of the next (linear in the group),
     which merges groups of near copies, however large. Round two then pairs only members of *different* components that
     share a hot key. Every pair is distinct, passes the suffix filter (parity bitmaps bound how much two whole sets can
     have in common) and is then verified against whole sets, so no link between components is lost, and the components
     are those of the full graph.
  5. Links join sets of one component only, so every set's number of links is counted inside its component: where keys are
     all rare, every link is verified already; the sets of a component that has hot keys meet each other once, in slices,
     and only the counts leave the task.
Ids are integers. Every row gives one row: repeated ones alike, and one of a null id with its n_shingles only (no component
and no links, for itself or others). Null and empty texts have the empty set and are their own component. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import chunks, connected_components, discard, materialize, tidy
from annalist.llm.shingles import mix, shingles, words

SEEN = 100_000
KEY_BITS = 8  # of a key, beyond those that it takes to count all shingles
BLOCK_ENTRIES = 600_000  # shingles of the texts that one block holds, about
RANGE_ENTRIES = 1_500_000  # shingles of the key range that one task counts
PART_ENTRIES = 1_500_000
BAND = 1.08
BITMAP = 16  # 64-bit words of a set's parity bitmap
FOLDED = 4  # words that it is folded to where many rows carry it
FEW = 16  # sets of a key that are paired at once
SLICE = 500  # sets of a hot key on one side of a meeting
TASK_PAIRS = 20_000_000  # pairs of hot keys' sets that one task compares
MAX_TASKS = 100_000
MEET_SETS = 2_000  # sets of a slice that meets other slices of its component
MEET_SHINGLES = 500_000  # and their shingles


def prefix_length(n: int, percent: int) -> int:
    """How many of its first shingles a set of n must show so that every partner shares one of them."""
    return n - -(-n * percent // 100) + 1


def index_length(n: int, percent: int) -> int:
    """The shorter prefix that suffices for the smaller set of a pair."""
    return n - -(-2 * n * percent // (100 + percent)) + 1


def set_code(h: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingle hashes; sets are told apart by it and their size."""
    code = int(h.sum(dtype=np.uint64) ^ np.uint64(len(h))) if len(h) else 0
    return code - (1 << 64) if code >= 1 << 63 else code


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """One row per text: id, n (set size), c (hash of the set), bits.

    bits is the parity bitmap: bit j tells whether an odd number of the set's shingles fall into hash range j. The bits
    in which two bitmaps differ are a lower bound of the number of shingles that only one of the sets has.
    """
    shift = np.uint64(64 - int(np.log2(64 * BITMAP)))

    def run(batches):
        for batch in chunks(batches, "text"):
            n, c, bits = [], [], []
            for h in shingles(batch.column("text"), k):
                n.append(len(h)), c.append(set_code(h))
                odd = np.bincount((h >> shift).astype(np.int64), minlength=64 * BITMAP) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names=["id", "n", "c", "bits"])

    return docs.mapInArrow(tidy(run), "id long, n long, c long, bits array<long>")


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed blob, byte plane by byte plane."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.compress(b"".join(planes), 1)


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    widths = [np.dtype(x).itemsize for x in kinds]
    rows, out, at = len(raw) // sum(widths), [], 0
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + rows * width].reshape(width, rows).T).view(kind).ravel())
        at += rows * width
    return out


ENTRY = (np.uint32, np.uint32, np.int64, np.int32, np.int32)  # key's low and high word, c, n, place


ROW = "dest long, block long, part int, payload array<binary>"


def _row(dest: int, block: int, part: int, payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([dest], pa.int64()), pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([payload], pa.list_(pa.binary()))], names=["dest", "block", "part", "payload"])


def frequency_code(times: np.ndarray) -> np.ndarray:
    """A byte that grows with a count: itself below 16, then eight steps for each doubling."""
    large = 16 + np.floor(8 * np.log2(np.maximum(times, 16) / 16))
    return np.minimum(np.where(times < 16, times, large), 255).astype(np.uint8)


def prefix_entries(docs: DataFrame, k: int, percent: int, total: int, parts: int) -> DataFrame:
    """(part, blob): the prefix entries of all sets, packed by part of the key space.

    A shingle's key is the upper part of its hash, KEY_BITS bits more than it takes to count all shingles; two shingles of
    one key only make a candidate that the verification rejects. A block of texts sends its distinct keys, with the
    number of its sets that have them, to the task that counts that range of keys over the corpus, and gets a byte for every
    key back. So a key that a third of all sets have arrives once for each block. Then the block puts each set's keys
    in order, rarest first, and keeps those of the prefix; keys that one set has come first and are left out.
    """
    bits = min(64, max(int(total).bit_length(), 1) + KEY_BITS)
    ranges = 1 + total // RANGE_ENTRIES
    step = -(-(1 << bits) // ranges)  # below 2**32, as RANGE_ENTRIES and KEY_BITS are

    def block_rows(block, hashes, codes, sizes):
        keys = np.concatenate(hashes) >> np.uint64(64 - bits)
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times = np.diff(np.append(first, len(keys))).astype(np.uint32)
        keys = keys[first]
        own = keys // np.uint64(step)
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist()
        yield _row(-1 - block, block, -1, [np.array(codes, np.int64).tobytes(), np.array(sizes, np.int32).tobytes(), _pack(owner), _pack(times)])
        for a, b in zip(cut, [*cut[1:], len(keys)], strict=True):
            part = int(own[a])
            inside = (keys[a:b] - np.uint64(part * step)).astype(np.uint32)
            yield _row(part, block, part, [_pack(np.diff(inside, prepend=np.uint32(0)), times[a:b])])

    def local(batches):
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 32
        seen, hashes, codes, sizes, size = set(), [], [], [], 0
        for batch in chunks(batches, "text"):
            for h in shingles(batch.column("text"), k):
                code = (set_code(h), len(h))
                if not len(h) or code in seen:  # a copy that this task has met adds nothing
                    continue
                if len(seen) < SEEN:
                    seen.add(code)
                hashes.append(h), codes.append(code[0]), sizes.append(code[1])
                size += len(h)
                if size > BLOCK_ENTRIES:
                    yield from block_rows(block, hashes, codes, sizes)
                    block, hashes, codes, sizes, size = block + 1, [], [], [], 0
        if size:
            yield from block_rows(block, hashes, codes, sizes)

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() < 0:
            for batch in batches:
                yield batch.select(["dest", "block", "part", "payload"])
            return
        part, blocks, keys, times = key[0].as_py(), [], [], []
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                steps, n = _unpack(payload[0], (np.uint32, np.uint32))
                blocks.append(block), keys.append(np.cumsum(steps, dtype=np.uint32)), times.append(n)
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        fresh = np.append(True, every[order][1:] != every[order][:-1])
        sums = np.add.reduceat(np.concatenate(times)[order].astype(np.int64), np.flatnonzero(fresh))
        codes = np.empty(len(every), np.uint8)
        codes[order] = frequency_code(sums)[np.cumsum(fresh) - 1]
        at = 0
        for block, own in zip(blocks, keys, strict=True):
            code = codes[at : at + len(own)]
            at += len(own)
            often = own[code > 1]
            yield _row(0, block, part, [_pack(code), _pack(np.diff(often, prepend=np.uint32(0)))])

    def assemble(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((p, x) for batch in batches for p, x in zip(batch.column("part").to_pylist(), batch.column("payload").to_pylist(), strict=True)), key=lambda r: r[0])
        set_codes, sizes, owner, times = rows[0][1]
        set_codes, sizes = np.frombuffer(set_codes, np.int64), np.frombuffer(sizes, np.int32)
        (owner,), (times,) = _unpack(owner, (np.uint32,)), _unpack(times, (np.uint32,))
        codes = np.concatenate([_unpack(x[0], (np.uint8,))[0] for _, x in rows[1:]])
        keys = np.concatenate([np.cumsum(_unpack(x[1], (np.uint32,))[0], dtype=np.uint32).astype(np.uint64) + np.uint64(p * step) for p, x in rows[1:]])
        often = codes > 1
        owner = owner[np.repeat(often, times)].astype(np.int64)
        keys, code = np.repeat(keys, times[often]), np.repeat(codes[often], times[often])
        order = np.lexsort((keys, code, owner))
        owner, keys = owner[order], keys[order]
        shared = np.bincount(owner, minlength=len(sizes))
        place = np.arange(len(owner)) - (np.cumsum(shared) - shared)[owner] + (sizes - shared)[owner]
        shown = np.array([prefix_length(n, percent) for n in sizes.tolist()])
        kept = place < shown[owner]
        owner, keys, place = owner[kept], keys[kept], place[kept].astype(np.int32)
        c, n = set_codes[owner], sizes[owner]
        part = (mix(keys) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])) if len(order) else np.zeros(0, np.int64)
        low, high = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint32)
        own = np.split(order, cut[1:]) if len(order) else []
        yield pa.RecordBatch.from_arrays([pa.array(part[order][cut], pa.int32()), pa.array([_pack(low[x], high[x], c[x], n[x], place[x]) for x in own], pa.binary())], names=["part", "blob"])

    counted = docs.select("text").mapInArrow(tidy(local), ROW).groupBy("dest").applyInArrow(tidy(count), ROW)
    return counted.groupBy("block").applyInArrow(tidy(assemble), "part int, blob binary")


def shared_entries(docs: DataFrame, k: int, percent: int, total: int) -> DataFrame:
    """Candidates (n, c, m, d) of sets (n, c) and (m, d) that share a key which few sets have; with m = -1, the entries
    (key, n, c, place) of hot keys.

    A part's task streams its entries and holds at most FEW entries of every key (keys are dealt evenly, whatever their
    counts); a hot key's entries are passed on at once.
    """
    parts = 1 + total * (100 - percent) // 100 // PART_ENTRIES

    def merge(held, new):
        """held: (keys, c, n, place, hot) sorted by key; returns the new held and the entries of hot keys to pass on.

        A key with more than FEW sets is hot: it keeps one marked entry and passes all its sets on.
        """
        keys, c, n, place = (np.concatenate((a, *b)) for a, b in zip(held[:4], zip(*new, strict=True), strict=True))
        hot = np.concatenate((held[4], np.zeros(len(keys) - len(held[4]), bool)))
        order = np.lexsort((place, n, c, ~hot, keys))
        keys, c, n, place, hot = keys[order], c[order], n[order], place[order], hot[order]
        same = np.append(False, (keys[1:] == keys[:-1]) & (c[1:] == c[:-1]) & (n[1:] == n[:-1]) & ~hot[:-1])
        keys, c, n, place, hot = keys[~same], c[~same], n[~same], place[~same], hot[~same]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(at, len(keys)))
        now = hot[at] | (size > FEW)
        in_hot = np.repeat(now, size)
        out = in_hot & ~hot
        keep = ~in_hot
        keep[at] = True
        hot = in_hot.copy()
        return (keys[keep], c[keep], n[keep], place[keep], hot[keep]), (keys[out], c[out], n[out], place[out])

    def paired(held):
        """The distinct pairs of sets that share a key which is not hot, under length and positional filter."""
        keys, c, n, place, hot = (x[~held[4]] for x in held)
        found = []
        for d in range(1, FEW):
            i = np.flatnonzero(keys[d:] == keys[:-d]) if len(keys) > d else np.zeros(0, np.int64)
            if not len(i):
                break
            j = i + d
            swap = n[i] > n[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            x, y = n[i].astype(np.int64), n[j].astype(np.int64)
            need = -(-percent * (x + y) // (100 + percent))
            fits = (100 * x >= percent * y) & (place[i] < x + (-2 * percent * x) // (100 + percent) + 1) & (np.minimum(x - place[i], y - place[j]) >= need)
            found.append(np.column_stack((x, c[i], y, c[j]))[fits])
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)

    def collect(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool))
        new, size = [], 0

        def rows(keys, n, c, place, m, d):
            return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in ((keys, np.int64), (n, np.int64), (c, np.int64), (place, np.int32), (m, np.int64), (d, np.int64))], names=["key", "n", "c", "place", "m", "d"])

        def entries(found):
            none = np.full(len(found[0]), -1)
            return rows(found[0], found[2], found[1], found[3], none, none)

        for batch in batches:
            for blob in batch.column("blob"):
                low, high, c, n, place = _unpack(blob.as_py(), ENTRY)
                new.append((low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), c, n, place))
                size += len(low)
                if size > max(len(held[0]), PART_ENTRIES // 4):
                    held, found = merge(held, new)
                    new, size = [], 0
                    yield entries(found)
        if new:
            held, found = merge(held, new)
            yield entries(found)
        pairs = paired(held)
        none = np.full(len(pairs), -1)
        yield rows(none, pairs[:, 0], pairs[:, 1], none, pairs[:, 2], pairs[:, 3])

    return prefix_entries(docs, k, percent, total, parts).groupBy("part").applyInArrow(tidy(collect), "key long, n long, c long, place int, m long, d long")


def _fits(percent: int):
    """Length filter and positional filter for pairs of key entries, smaller set first (n, place) against (m, at)."""
    need = f"ceil({percent} * (n + m) / {100 + percent})"
    return f"100 * n >= {percent} * m AND place < n - ceil({2 * percent} * n / {100 + percent}) + 1 AND 1 + least(n - place, m - at) - 1 >= {need}"


def verify(pairs: DataFrame, maps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (a, b) of the distinct pairs whose whole sets link, as a written table. maps: id, n, bits of the suffix filter; texts: id, text."""
    left, right = (maps.select(F.col("id").alias(i), F.col("n").alias(n), F.col("bits").alias(x)) for i, n, x in (("a", "na", "xa"), ("b", "nb", "xb")))
    apart = " + ".join(f"bit_count(xa[{i}] ^ xb[{i}])" for i in range(BITMAP))
    near = pairs.join(left, "a").join(right, "b").where(f"{apart} <= na + nb - 2 * ceil({percent} * (na + nb) / {100 + percent})")
    pairs = near_pairs = materialize(near.select("a", "b").distinct(), "near")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()

    def sets(batches):
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([h.tobytes() for h in shingles(batch.column("text"), k)], pa.large_binary()).cast(pa.binary())], names=["id", "items"])

    items = materialize(texts.join(wanted, "id", "left_semi").mapInArrow(tidy(sets), "id long, items binary"), "sets")
    edges = np.arange(1, 64, dtype=np.uint64) << np.uint64(58)

    def check(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                # links when 100 * common >= percent * (n + m - common)
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                if len(x) > 64:  # suffix filter: what 64 ranges of the hash space can have in common at most
                    parts = [np.diff(np.concatenate(([0], np.searchsorted(z, edges), [len(z)]))) for z in (x, y)]
                    if np.minimum(*parts).sum() < need:
                        continue
                keep[i] = len(np.intersect1d(x, y, assume_unique=True)) >= need
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    left = items.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = items.select(F.col("id").alias("b"), F.col("items").alias("y"))
    out = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(check), "a long, b long"), "links")
    discard(near_pairs, items)
    return out


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of x has in common with each of y."""
    sizes = [len(z) for z in (*x, *y)]
    codes = np.unique(np.concatenate((*x, *y)), return_inverse=True)[1].ravel()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    split = int(sum(sizes[: len(x)]))
    order = [np.argsort(z, kind="stable") for z in (codes[:split], codes[split:])]
    cx, cy = codes[:split][order[0]], codes[split:][order[1]]
    ox, oy = owner[:split][order[0]], owner[split:][order[1]] - len(x)
    n = int(codes.max()) + 1
    tx, ty = np.bincount(cx, minlength=n), np.bincount(cy, minlength=n)
    out = np.zeros((len(x), len(y)), np.int32)
    pairs = tx * ty
    dense = pairs * 64 > len(x) * len(y)
    # Shingles that many sets have: products of 0/1 matrices (exact, as every sum is far below 2**24).
    often = np.flatnonzero(dense)
    for at in range(0, len(often), 1024):
        place = np.full(n, -1)
        place[often[at : at + 1024]] = np.arange(len(often[at : at + 1024]))
        a, b = (np.zeros((len(z), 1024), np.float32) for z in (x, y))
        for m, o, c in ((a, ox, place[cx]), (b, oy, place[cy])):
            m[o[c >= 0], c[c >= 0]] = 1
        out += (a @ b.T).astype(np.int32)
    # The others: every pair of owners.
    seldom = np.flatnonzero(~dense & (pairs > 0))
    first_x, first_y = np.cumsum(tx) - tx, np.cumsum(ty) - ty
    upto = np.cumsum(pairs[seldom])
    begin = 0
    while begin < len(seldom):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + 4_000_000, "right")))
        own = np.repeat(seldom[begin:end], pairs[seldom[begin:end]])
        start = np.cumsum(pairs[seldom[begin:end]]) - pairs[seldom[begin:end]]
        step = np.arange(len(own)) - np.repeat(start, pairs[seldom[begin:end]])
        i, j = ox[first_x[own] + step // ty[own]], oy[first_y[own] + step % ty[own]]
        out += np.bincount(i * len(y) + j, minlength=out.size).reshape(out.shape).astype(np.int32)
        begin = end
    return out


def count_links(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(rep, inside): each set's links to the other sets of its component. members: n, c, rep, comp, slices."""

    def sets(batches):
        for batch in chunks(batches, "text"):
            got = list(shingles(batch.column("text"), k))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(h) for h in got], pa.int64()), pa.array([set_code(h) for h in got], pa.int64()), pa.array([h.tobytes() for h in got], pa.large_binary()).cast(pa.binary())], names=["rep", "n", "c", "items"])

    def meet(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        side = table.column("slice").to_numpy()
        reps = table.column("rep").to_numpy()
        items = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("items")]
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        x, y = [items[a] for a in left], [items[b] for b in right]
        if not x or not y:
            return pa.table({"rep": pa.array([], pa.int64()), "inside": pa.array([], pa.int64())})
        common = common_counts(x, y).astype(np.int64)
        total = np.array([len(z) for z in x])[:, None] + np.array([len(z) for z in y])[None, :]
        linked = 100 * common >= percent * (total - common)
        if i == j:
            np.fill_diagonal(linked, False)
            return pa.table({"rep": reps[left], "inside": linked.sum(1, dtype=np.int64)})
        return pa.table({"rep": np.concatenate((reps[left], reps[right])), "inside": np.concatenate((linked.sum(1, dtype=np.int64), linked.sum(0, dtype=np.int64)))})

    wanted = texts.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    # A set's smallest id may carry other texts too, and the same one again.
    items = wanted.mapInArrow(tidy(sets), "rep long, n long, c long, items binary").join(members, ["rep", "n", "c"]).dropDuplicates(["n", "c"])
    sliced = items.withColumn("slice", F.pmod(F.xxhash64("n", "c"), F.col("slices")).cast("int"))
    met = sliced.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("comp", "rep", "slice", F.least("slice", "to").alias("i"), F.greatest("slice", "to").alias("j"), "items")
    return met.groupBy("comp", "i", "j").applyInArrow(meet, "rep long, inside long").groupBy("rep").agg(F.sum("inside").alias("inside"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(id_col, n_shingles, component_id, class_id, n_links): every row's set size, component, class of equal sets
    (its smallest id) and the number of other classes that the class links with; ids keep their type (integers)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = materialize(signatures(texts, k), "signatures")
    texts = texts.where("id IS NOT NULL")
    least = base.where("n > 0 AND id IS NOT NULL").groupBy("c", "n").agg(F.min(F.struct("id", "bits")).alias("x"))
    sets = materialize(least.select("c", "n", F.col("x.id").alias("rep"), F.col("x.bits").alias("bits")), "classes")
    reps = sets.select("c", "n", "rep")
    maps = sets.select(F.col("rep").alias("id"), "n", "bits")
    total = base.agg(F.sum("n")).first()[0] or 0
    entries = materialize(shared_entries(texts, k, percent, total), "entries")
    found = materialize(entries.where("m < 0").select("key", "n", "c", "place").distinct().join(reps, ["c", "n"]).select("key", F.col("rep").alias("id"), F.col("n"), F.col("place")), "hot")
    other = reps.select(F.col("c").alias("d"), F.col("n").alias("m"), F.col("rep").alias("rep2"))
    few = entries.where("m >= 0").select("n", "c", "m", "d").distinct().join(reps, ["c", "n"]).join(other, ["d", "m"]).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))
    # Round one: stars. In each key's group, every set is paired with the hub (smallest id) of its own band of sizes and of the next.
    banded = found.withColumn("band", F.floor(F.log("n") / float(np.log(BAND))))
    hubs = banded.groupBy("key", "band").agg(F.min(F.struct("id", "n", "place")).alias("h")).select("key", F.explode(F.array("band", F.col("band") - 1)).alias("band"), "h")
    met = banded.join(hubs, ["key", "band"]).where("id <> h.id")
    first = F.struct("n", "id") < F.struct("h.n", "h.id")
    ordered = met.select(*(F.when(first, x).otherwise(y).alias(z) for x, y, z in ((F.col("n"), F.col("h.n"), "n"), (F.col("place"), F.col("h.place"), "place"), (F.col("h.n"), F.col("n"), "m"), (F.col("h.place"), F.col("place"), "at"))), F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b"))
    star = ordered.where(_fits(percent)).select("a", "b").union(few).distinct()
    star = materialize(star, "stars")
    links = verify(star, maps, texts, k, percent)
    groups = connected_components(links)
    # Round two: members of different components that share a key.
    named = found.join(groups, found.id == groups.node, "left").select("key", "id", "n", "place", F.coalesce("component", "id").alias("comp"))
    open_keys = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).where("x <> y")
    open_keys = materialize(open_keys.select("key", "size"), "open")
    work = open_keys.agg(F.sum(F.col("size").cast("double") ** 2)).first()[0] or 0.0
    tasks = int(min(1 + work // TASK_PAIRS, MAX_TASKS))
    slices = open_keys.select("key", F.ceil(F.col("size") / SLICE).cast("int").alias("slices"))
    folded = [F.expr(" ^ ".join(f"bits[{i + j}]" for j in range(0, BITMAP, FOLDED))).alias(f"w{i}") for i in range(FOLDED)]
    # A pair's sizes lie in the same band or in neighbouring ones; a group of many sets is cut into slices that each meet all of it.
    band = F.floor(F.log("n") / float(np.log(100.5 / percent)))
    rest = materialize(named.join(slices, "key").join(maps.select("id", *folded), "id").withColumn("band", band), "rest")
    words_of = lambda side: [F.col(f"w{i}").alias(f"{side}{i}") for i in range(FOLDED)]
    meeting = ["key", "band", "slice"]
    left = rest.select("key", "band", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.col("id").alias("p"), F.col("n"), F.col("place"), F.col("comp").alias("cp"), *words_of("x"))
    right = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    right = right.select("key", F.explode(F.array("band", F.col("band") - 1)).alias("band"), "slice", F.col("id").alias("q"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("comp").alias("cq"), *words_of("y"))
    left, right = (side.repartition(tasks, *meeting) for side in (left, right))
    apart = " + ".join(f"bit_count(x{i} ^ y{i})" for i in range(FOLDED))
    near = f"{_fits(percent)} AND {apart} <= n + m - 2 * ceil({percent} * (n + m) / {100 + percent})"
    met = left.hint("shuffle_hash").join(right, meeting).where(f"cp <> cq AND (n < m OR n = m AND p < q) AND {near}")
    crossed = materialize(met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "cross")
    cross = crossed.join(star, ["a", "b"], "left_anti")
    found_links = verify(cross, maps, texts, k, percent)
    # Only the links of round two are new, so the second search runs over the components of the first.
    ends = [groups.select(F.col("node").alias(x), F.col("component").alias(f"{x}_comp")) for x in "ab"]
    named = found_links.join(ends[0], "a", "left").join(ends[1], "b", "left")
    merged = connected_components(named.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")))
    every = links.union(found_links)
    degree = every.select(F.col("a").alias("rep")).union(every.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    first = reps.join(groups, reps.rep == groups.node, "left").select("c", "n", "rep", F.coalesce("component", "rep").alias("one"))
    classes = first.join(merged.toDF("one", "two"), "one", "left").join(degree, "rep", "left").select("c", "n", "rep", F.coalesce("two", "one").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classes = materialize(classes, "classes")
    # Links that only hot keys show are verified between components and with hubs; inside a component they are counted.
    hot = classes.join(found.select(F.col("id").alias("rep")).distinct(), "rep", "left_semi").select("comp").distinct()
    sizes = classes.join(hot, "comp", "left_semi").groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1")
    sizes = sizes.select("comp", F.greatest(F.ceil(F.col("m") / MEET_SETS), F.ceil(F.col("total") / MEET_SHINGLES)).cast("int").alias("slices"))
    members = materialize(classes.join(sizes, "comp").select("n", "c", "rep", "comp", "slices"), "members")
    inside = materialize(count_links(members, texts, k, percent), "inside")
    # A smallest id that several sets share has all their links, as the verified ones have it.
    classes = classes.join(inside, "rep", "left").withColumn("n_links", F.coalesce("inside", "n_links"))
    discard(sets, entries, found, star, links, groups, open_keys, rest, crossed, found_links, merged, members)
    out = base.select("id", "n", "c").join(classes, (base.c == classes.c) & (base.n == classes.n) & base.id.isNotNull(), "left")
    return out.select(base.id.alias(id_col), base.n.alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
