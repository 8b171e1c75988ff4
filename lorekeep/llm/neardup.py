"""Problem 4: pairs of texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

Prefix filtering: the shingles of a text are put into one order for all texts, rarest first, and two texts that are
similar enough share one of the first ``size - ceil(t * size) + 1``. Texts are joined on those, and a joined pair must
pass the length filter, the positional filter and a lower bound of the sets' symmetric difference from parity bitmaps of the whole sets. What passes meets
the whole sets, and there the suffix filter (the bound that halving both sets at pivots gives, ``DEPTH`` times) and what is left is verified once per pair. All filters are exact; shingles are compared as
hashes of 44 bits.

The order comes from counts of all texts' shingles in a table whose size grows with the corpus; shingles that share a bucket
only blur it. Texts with equal sets are one record throughout. A shingle whose count says that more than ``HOT`` texts hold it is
joined in blocks, so that no task compares more than ``HOT`` texts with each other. Postings travel packed, one row for each task and
partition, because a row for each would double the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.leak import Words
from lorekeep.llm.text_runs import chunks, windows
from lorekeep.operators.skew import join_on_key
from lorekeep.session import durable, written

SHINGLE, LEAST_WORDS = 3, 10
#: Buckets that shingles are counted in: a quarter of the shingles, about, but no fewer and no more than these.
BUCKETS, MOST_BUCKETS = 1 << 20, 1 << 27
#: Steps of a count's byte for each doubling.
STEPS = 6
HOT = 20_000
#: Parity bitmaps have two bits for each shingle at least, in a power of two from 128 to 128 << LARGEST.
LARGEST = 6
#: Postings that one task of the join gets, about.
POSTINGS = 1_500_000
#: Bits of the filter that keeps the texts of candidates in the last pass (fixed size, whatever the corpus).
KEPT_BITS = 1 << 24
#: How often the suffix filter halves the sets.
DEPTH = 3
#: Groups of exact copies of a text up to this size come out as all pairs, larger ones as pairs with the smallest id.
ALL_PAIRS = 100
#: Members of a set that one task pairs with the others of it, about.
SET_ROWS = 1_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Sets:
    """The shingle sets of one column's texts: sorted (text, hash) rows and, for each text that is compared, its key and size."""

    def __init__(self, texts: list[str], shingle: int, least_words: int, field: int):
        w = Words(texts)
        h = windows(w.hashes, shingle)
        n_words = w.upto - w.first
        # a text's windows begin at its words but the last shingle - 1
        sizes = np.where(n_words >= max(least_words, shingle), n_words - shingle + 1, 0)
        at = np.repeat(w.first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        text = np.repeat(np.arange(len(texts)), sizes).astype(np.uint64)
        rows = np.sort((text << np.uint64(44)) | (h[at] >> np.uint64(20)))
        rows = rows[np.concatenate([[True], rows[1:] != rows[:-1]])] if len(rows) else rows
        self.text = (rows >> np.uint64(44)).astype(np.int64)
        self.hash = rows & np.uint64((1 << 44) - 1)
        self.texts, self.begin, self.size = np.unique(self.text, return_index=True, return_counts=True)
        mixed = (self.hash + np.uint64(field + 1)) * _MIX
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        self.mixed = mixed
        #: equal for equal sets of one field
        self.key = np.add.reduceat(mixed, self.begin) if len(rows) else mixed
        self.key = (self.key ^ (self.size.astype(np.uint64) * _MIX)).view(np.int64)


def sets(batch: pa.RecordBatch, columns: int, shingle: int, least_words: int) -> Iterator[tuple[int, int, Sets]]:
    """(field, index of the first text, sets) for the text columns of a batch."""
    for field in range(columns):
        for first, part in chunks(batch.column(field + 1).to_pylist()):
            s = Sets(part, shingle, least_words, field)
            if len(s.texts):
                yield field, first, s


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes, six steps for each doubling; 0 only for 0."""
    return np.ceil(np.log2(counts + 1.0) * STEPS).astype(np.uint8)


def _levels(df: DataFrame, columns: int, shingle: int, least_words: int) -> tuple[np.ndarray, int]:
    """(levels, shingles in all). How many sets hold a shingle of each bucket, as :func:`levels_of`.

    There is about a bucket for every four shingles in the corpus, between BUCKETS and MOST_BUCKETS; that many bytes reach the driver and the tasks.
    """
    chars = df.agg(*[F.sum(F.length(f"__t{i}")) for i in range(columns)]).first()
    width = 1 << int(np.clip(np.ceil(np.log2(max(1, sum(c or 0 for c in chars) / 24))), np.log2(BUCKETS), np.log2(MOST_BUCKETS)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            # three bytes for each bucket; a count beyond a byte takes several entries
            times = -(-n // 255)
            low, piece = np.repeat(at & 0xFFFF, times).astype(np.uint16), np.repeat(at >> 16, times)
            n = np.where(np.append(np.diff(np.repeat(at, times)) != 0, True), np.repeat(n - (times - 1) * 255, times), 255).astype(np.uint8)
            edge = np.flatnonzero(np.append(True, np.diff(piece) != 0))
            ends = [*edge[1:].tolist(), len(piece)]
            blobs = [[x[i:j].tobytes() for i, j in zip(edge.tolist(), ends)] for x in (low, n)]
            return pa.RecordBatch.from_arrays([pa.array(piece[edge].astype(np.int32)), *[pa.array(x, pa.binary()) for x in blobs]], ["piece", "low", "n"])

        for b in batches:
            for _, _, s in sets(b, columns, shingle, least_words):
                held.append((s.mixed & np.uint64(width - 1)).astype(np.int64))
                if sum(map(len, held)) > 4_000_000:
                    yield flush()
        if held:
            yield flush()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << 16, np.int64)
        for low, n in zip(pdf["low"], pdf["n"]):
            total += np.bincount(np.frombuffer(low, np.uint16), np.frombuffer(n, np.uint8), 1 << 16).astype(np.int64)
        return pd.DataFrame({"piece": [int(pdf["piece"].iloc[0])], "levels": [levels_of(total).tobytes()], "total": [int(total.sum())]})

    rows = df.mapInArrow(count, "piece int, low binary, n binary").groupBy("piece").applyInPandas(add, "piece int, levels binary, total bigint").collect()
    out = np.zeros(width, np.uint8)
    for r in rows:
        out[r["piece"] << 16 : (r["piece"] + 1) << 16] = np.frombuffer(r["levels"], np.uint8)
    return out, sum(r["total"] for r in rows)


def least_overlap(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """ceil(t / (1 + t) * (a + b)) for t = num / den: the least number of common shingles."""
    return -(-(num * (a + b)) // (num + den))


def grade(size: np.ndarray) -> np.ndarray:
    """Bitmaps of grade g have 128 << g bits."""
    return np.clip(np.ceil(np.log2(np.maximum(size, 1) / 64)), 0, LARGEST).astype(np.int64)


def _postings(s: Sets, levels: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record, token, position) of the prefixes, rarest first, and the bitmaps of all records of ``s`` one after the other."""
    level = levels[(s.mixed & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64)
    record = np.repeat(np.arange(len(s.texts)), s.size)
    token = (level << np.uint64(36)) | (s.mixed >> np.uint64(28))
    order = np.sort((record.astype(np.uint64) << np.uint64(44)) | token)
    position = np.arange(len(order)) - np.repeat(s.begin, s.size)
    size = s.size[record]
    keep = position < size + (-(num * size) // den) + 1
    bits = 128 << grade(s.size)
    base = np.cumsum(bits) - bits
    bit = ((s.mixed >> np.uint64(20)).astype(np.int64) & (bits - 1)[record]) + base[record]
    odd = np.bincount(bit, minlength=int(bits.sum())) & 1
    bitmaps = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
    return record[keep], order[keep] & np.uint64((1 << 44) - 1), position[keep], bitmaps


def _take_bitmaps(flat: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The bitmaps of ``rows``, from those of records of the given sizes."""
    n = 2 << grade(size)
    begin = np.cumsum(n) - n
    m = n[rows]
    return flat[np.repeat(begin[rows] - (np.cumsum(m) - m), m) + np.arange(m.sum())]


class Bitmaps:
    """Parity bitmaps of each grade; those of larger sets are folded, so that any two sets can be compared at the smaller grade."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.grade = grade(size)
        n = 2 << self.grade
        begin = np.cumsum(n) - n
        self.rows: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        above = None
        for g in range(int(self.grade.max(initial=0)), -1, -1):
            own = np.flatnonzero(self.grade == g)
            m = flat[begin[own][:, None] + np.arange(2 << g)]
            index = own
            if above is not None:
                half = 2 << g
                m = np.concatenate([m, self.rows[g + 1][:, :half] ^ self.rows[g + 1][:, half:]])
                index = np.concatenate([own, above])
            self.rows[g], above = m, index
            self.place[g] = np.zeros(len(size), np.int32)
            self.place[g][index] = np.arange(len(index))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A lower bound of the number of shingles that only one of two sets holds."""
        out = np.zeros(len(a), np.int64)
        both = np.minimum(self.grade[a], self.grade[b])
        for g in self.rows:
            at = np.flatnonzero(both == g)
            x, y = self.place[g][a[at]], self.place[g][b[at]]
            out[at] = np.bitwise_count(self.rows[g][x] ^ self.rows[g][y]).sum(1)
        return out


def _split_hot(record: np.ndarray, token: np.ndarray, position: np.ndarray, key: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of tokens with more than ``hot`` texts, once for each pair of blocks that the text's block is in."""
    n = np.ceil(2.0 ** ((token >> np.uint64(36)).astype(np.float64) / STEPS) / hot).astype(np.int64)
    many = n > 1
    if not many.any():
        return record, token, position
    r, t, p, n = record[many], token[many], position[many], n[many]
    own = (key[r].view(np.uint64) % n.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(n)), n)
    other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    low, high = np.minimum(own[at], other), np.maximum(own[at], other)
    cell = (t[at] * np.uint64(0xD1342543DE82EF95)) ^ ((low * n[at] + high + 1).astype(np.uint64) * _MIX)
    return np.concatenate([record[~many], r[at]]), np.concatenate([token[~many], cell]), np.concatenate([position[~many], p[at]])


def _pack(arrays: list[np.ndarray]) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


#: key, size, number of postings and bitmaps of the records; token and position of the postings, by record
_KINDS = (np.int64, np.int32, np.int32, np.uint64, np.uint32, np.uint16)


def _unpack(blob: bytes) -> list[np.ndarray]:
    """The packed arrays; tokens are 32-bit hashes (equal ones of different shingles only add candidates), positions end at 65,535 (a smaller one only weakens its filter)."""
    lengths = np.frombuffer(blob, np.int64, len(_KINDS))
    out, at = [], 8 * len(_KINDS)
    for n, kind in zip(lengths, _KINDS):
        out.append(np.frombuffer(blob, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def pairs_of(key: np.ndarray, size: np.ndarray, bitmap: np.ndarray, record: np.ndarray, token: np.ndarray, position: np.ndarray, num: int, den: int, step: int = 1 << 20) -> np.ndarray:
    """Keys of the pairs of records that share a token and pass the filters, each pair once, as rows (smaller, larger)."""
    key, first, same = np.unique(key, return_index=True, return_inverse=True)
    bitmaps = Bitmaps(_take_bitmaps(bitmap, size, first), size[first])
    size, record = size[first].astype(np.int64), same[record]
    _, token = np.unique(token, return_inverse=True)
    order = np.lexsort((record, size[record], token))
    record, token, position = record[order], token[order], position[order].astype(np.int64)
    once = np.concatenate([[True], (np.diff(record) != 0) | (np.diff(token) != 0)]) if len(record) else np.zeros(0, bool)
    record, token, position = record[once], token[once], position[once]
    size_at = size[record]
    width = int(size.max(initial=0)) + 1
    # partners: later ones of the same token, up to the length that is still similar enough, by size and by own position
    left = size_at - position
    longest = np.minimum(size_at * den // num, (left * (num + den) - num * size_at) // num)
    upto = np.searchsorted(token * width + size_at, token * width + np.clip(longest, -1, width - 1), "right")
    n = np.maximum(upto - np.arange(len(record)) - 1, 0)
    bounds = np.searchsorted(np.cumsum(n), np.arange(step, int(n.sum()), step))
    out, begin = [], 0
    for stop in [*(bounds + 1).tolist(), len(n)]:
        if stop <= begin:
            continue
        m = n[begin:stop]
        a = np.repeat(np.arange(begin, stop), m)
        b = np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m) + a + 1
        begin = stop
        total = size_at[a] + size_at[b]
        ok = left[b] * (num + den) >= num * total
        a, b, total = record[a[ok]], record[b[ok]], total[ok]
        ok = bitmaps.apart(a, b) <= total - 2 * -(-(num * total) // (num + den))
        if ok.any():
            a, b = key[a[ok]], key[b[ok]]
            out.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def candidates(df: DataFrame, columns: int, num: int, den: int, shingle: int, least_words: int, hot: int) -> DataFrame:
    """(``a``, ``b``): keys of record pairs that pass the filters; a pair can come more than once."""
    spark = df.sparkSession
    table, total = _levels(df, columns, shingle, least_words)
    levels = spark.sparkContext.broadcast(table)
    parts = max(8, int(total * (1 - num / den)) // POSTINGS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            base = np.cumsum([0, *[len(x[0]) for x in held[:-1]]])
            key, size, bitmap, record, token, position = (np.concatenate([x[k] + (b if k == 3 else 0) for x, b in zip(held, base)]) for k in range(6))
            held.clear()
            # equal sets of this task are one record
            _, first, same = np.unique(key, return_index=True, return_inverse=True)
            own = first[same[record]] == record
            record, token, position = _split_hot(record[own], token[own], position[own], key, hot)
            mixed = token * _MIX
            part = (mixed >> np.uint64(33)) % np.uint64(parts)
            order = np.lexsort((record, part))
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            blobs = []
            for p in range(parts):
                rows = order[edge[p] : edge[p + 1]]
                used, n = np.unique(record[rows], return_counts=True)
                short = ((token[rows] ^ (mixed[rows] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
                arrays = [key[used], size[used], n, _take_bitmaps(bitmap, size, used), short, np.minimum(position[rows], 65535)]
                blobs.append(_pack([np.asarray(a, kind) for a, kind in zip(arrays, _KINDS)]))
            return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

        waiting = 0
        for b in batches:
            for _, _, s in sets(b, columns, shingle, least_words):
                record, token, position, bitmap = _postings(s, levels.value, num, den)
                held.append([s.key, s.size, bitmap, record, token, position])
                waiting += len(record)
                if waiting > 2_000_000:
                    waiting = 0
                    yield flush()
        if held:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        key, size, n, bitmap, token, position = (np.concatenate(x) for x in zip(*map(_unpack, pdf["blob"])))
        found = pairs_of(key, size, bitmap, np.repeat(np.arange(len(key)), n), token, position, num, den)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return df.mapInArrow(emit, "part int, blob binary").groupBy("part").applyInPandas(meet, "a bigint, b bigint")


def suffix_bound(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, to_a: np.ndarray, at_b: np.ndarray, to_b: np.ndarray, depth: int) -> np.ndarray:
    """A lower bound of the number of elements that only one of two sets holds, for many pairs at once.

    The sets are stretches of the sorted arrays ``a`` and ``b``. The middle element of the second splits both in halves, and what the halves
    differ by in size, at the last depth, must differ.
    """
    if not depth:
        return np.abs((to_a - at_a) - (to_b - at_b))
    some = to_b > at_b
    middle = np.minimum((at_b + to_b) // 2, max(len(b) - 1, 0))
    if not len(b):
        return to_a - at_a
    cut = np.clip(np.searchsorted(a, b[middle]), at_a, to_a)
    found = some & (cut < to_a) & (a[np.minimum(cut, max(len(a) - 1, 0))] == b[middle]) if len(a) else np.zeros(len(cut), bool)
    low = suffix_bound(a, b, at_a, cut, at_b, np.maximum(middle, at_b), depth - 1)
    high = suffix_bound(a, b, cut + found, to_a, np.minimum(middle + 1, to_b), to_b, depth - 1)
    return np.where(some, low + high + ~found, to_a - at_a)


def verified(num: int, den: int):
    """Of pairs with their sorted sets those whose Jaccard similarity is ``num / den`` at least: suffix filter, then the common elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (la, a), (lb, b) = ((x.value_lengths().to_numpy(), x.flatten().to_numpy().view(np.uint64)) for x in (batch.column(2), batch.column(3)))
            # at most 2^20 pairs at once, so that pair and hash fit into 64 bits
            pair = np.arange(len(la), dtype=np.uint64) << np.uint64(44)
            a, b = a | np.repeat(pair, la), b | np.repeat(pair, lb)
            end_a, end_b = np.cumsum(la), np.cumsum(lb)
            total = la.astype(np.int64) + lb
            least = -(-(num * total) // (num + den))
            near = suffix_bound(a, b, end_a - la, end_a, end_b - lb, end_b, DEPTH) <= total - 2 * least
            left = a[np.repeat(near, la)]
            at = np.searchsorted(b, left)
            equal = b[np.minimum(at, len(b) - 1)] == left if len(b) else np.zeros(0, bool)
            common = np.bincount((left[equal] >> np.uint64(44)).astype(np.int64), minlength=len(la))
            yield batch.filter(pa.array(near & (common >= least))).select(["a", "b"])

    return run


@lru_cache(1)
def _no_bits() -> np.ndarray:
    return np.zeros(KEPT_BITS, bool)


def similar_pairs(df: DataFrame, id_col: str, text_cols: list[str], num: int = 4, den: int = 5, shingle: int = 5, least_words: int = 10, hot: int = HOT) -> DataFrame:
    """(``id_a``, ``id_b``), distinct and with ``id_a < id_b``: rows of which one of ``text_cols`` is similar in both.

    Similar: a Jaccard similarity of at least ``num / den`` over the sets of ``shingle`` consecutive words. Texts that are
    null or have fewer than ``least_words`` words are similar to none; rows with the same id are one row, rows without id
    none. Of a group of more than ALL_PAIRS ids with the very same text, each id comes out with the smallest one only, which also stands for
    the group in pairs with other texts; :func:`members` gives the groups. Different texts of equal sets are paired like all others.
    Ids must be strings; other columns aren't read.
    """
    spark = df.sparkSession
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__t{i}") for i, c in enumerate(text_cols)])
    hashed = texts.select("*", *[F.xxhash64(f"__t{i}").alias(f"__h{i}") for i in range(len(text_cols))])
    columns = len(text_cols)
    found = durable(candidates(texts, columns, num, den, shingle, least_words, hot).distinct())

    def bits(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _no_bits().copy()
        for pdf in it:
            for c in ("a", "b"):
                own[pdf[c].to_numpy().view(np.uint64) % np.uint64(KEPT_BITS)] = True
        packed = np.packbits(own)
        at = np.flatnonzero(packed)
        yield pd.DataFrame({"at": at.astype(np.int32), "byte": packed[at].astype(np.int16)})

    kept = np.zeros(KEPT_BITS // 8, np.uint8)
    filled = found.mapInPandas(bits, "at int, byte smallint").groupBy("at").agg(F.bit_or("byte").alias("byte")).toPandas()
    kept[filled["at"].to_numpy(np.int64)] = filled["byte"].to_numpy(np.uint8)
    shared = spark.sparkContext.broadcast(kept)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(shared.value).view(bool)
        for b in batches:
            for field, first, s in sets(b, columns, shingle, least_words):
                copy = b.column(1 + columns + field).take(pa.array(s.texts + first))
                ids = b.column(0).take(pa.array(s.texts + first))
                wanted = maybe[s.key.view(np.uint64) % np.uint64(KEPT_BITS)]
                offsets = np.append(0, np.cumsum(np.where(wanted, s.size, 0))).astype(np.int32)
                values = s.hash[np.repeat(wanted, s.size)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s.key), ids, copy, pa.ListArray.from_arrays(offsets, pa.array(values))], ["key", "id", "copy", "shingles"])

    rows = written(hashed.mapInArrow(members, "key bigint, id string, copy bigint, shingles array<bigint>"))
    one = rows.where(F.size("shingles") > 0).groupBy("key").agg(F.first("shingles").alias("shingles"))
    a = one.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    b = one.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    alike = written(found.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(verified(num, den), "a bigint, b bigint"))
    # only the texts of sets that are similar to another, or that several have, take part in what follows
    every = rows.select("key", "copy", "id").distinct()
    several = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    wanted = several.unionByName(alike.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    t = written(every.join(wanted, "key", "left_semi"))
    # of equal sets: exact copies of a text
    copies = t.groupBy("key", "copy").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("x")).where("n > 1")
    # of many copies of a text the first stands for all
    m = t.join(copies.where(F.col("n") > ALL_PAIRS), ["key", "copy"], "left").where(F.col("n").isNull() | (F.col("id") == F.col("x"))).select("key", "id").distinct()
    both = alike.join(m.select(F.col("key").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("key").alias("b"), F.col("id").alias("y")), "b")
    star = t.withColumnRenamed("id", "y").join(copies, ["key", "copy"]).where(F.col("x") < F.col("y")).select("key", "copy", "n", "x", "y")
    small = star.where(F.col("n") <= ALL_PAIRS).select("key", "copy", "y")
    rest = small.withColumnRenamed("y", "x").join(small, ["key", "copy"]).where(F.col("x") < F.col("y"))
    # and different texts, large sets spread over salts
    many = t.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SET_ROWS).cast("int").alias("salts"), F.min("copy").alias("low"), F.max("copy").alias("high")).where("low < high").select("key", "salts")
    mixed = t.join(many, "key")
    one_side = mixed.select("key", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("copy").alias("cx"), F.col("id").alias("x"))
    other_side = mixed.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("copy").alias("cy"), F.col("id").alias("y"))
    differ = one_side.join(other_side, ["key", "salt"]).where((F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")))
    every = both.select("x", "y").unionByName(star.select("x", "y")).unionByName(rest.select("x", "y")).unionByName(differ.select("x", "y")).where(F.col("x") != F.col("y"))
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def members(df: DataFrame, id_col: str, text_cols: list[str], least_words: int = LEAST_WORDS) -> DataFrame:
    """(``field``, ``id``, ``class_id``, ``n_copies``): for every text that is compared the smallest id with the very same text, and how many ids have it.

    What holds for the text of ``class_id`` holds for every copy. Rows with the same id are one row; null ids and texts, and texts of
    fewer than ``least_words`` words, give none.
    """
    n_words = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)")))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in text_cols]))
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), each.alias("t")).select("id", "t.field", "t.text")
    texts = texts.where(F.col("text").isNotNull() & (n_words >= least_words)).select("id", "field", F.sha2(F.concat("field", F.lit("\n"), "text"), 256).alias("copy")).distinct()
    classes = texts.groupBy("copy").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    return join_on_key(texts, classes, "copy", "inner").select("field", "id", "class_id", "n_copies")
