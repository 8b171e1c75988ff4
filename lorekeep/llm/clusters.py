"""Problem 5: clusters of records whose vectors are alike.

Each vector becomes a set: the quarter of its coordinates that are largest, with their signs, in some random rotations. MinHash banding
of the sets gives candidate pairs: a band of one MinHash (of BANDS) brings records together, and of those the pairs that also share an
inner band of at least WIDTH further MinHashes. Every candidate pair is verified by the exact Jaccard similarity of the two sets, and what passes by
the cosine that defines a link. Linked records are joined within each task first, and connected components of what the tasks
report give the clusters.

A record is sent once for each band, as 8-bit vector, whatever the number of records; sets and inner MinHashes are worked out again in the task. The buckets of a band
are spread over parts of about PART_ROWS records by their exact counts; one with more than BUCKET_ROWS is cut into blocks, and every two of its blocks meet in a part
of their own, so a part is bounded and no pair is left out. The inner bands widen with the part, so that candidates per record don't grow.

8-bit vectors have a bounded error: only links within that bound of the threshold, and only if they join different clusters, are
decided on the whole vectors. Where many records share an inner band, each is first held against one of them; then those
outside the largest cluster against all, in blocks, so that a dense group of n records costs n comparisons, not n^2, and no
pair of different clusters is left out. Equal vectors are one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.llm.neighbours import exact_cosines, keys, members_and_vectors, usable
from lorekeep.operators.skew import join_on_key
from lorekeep.session import durable, written

#: Coordinates that sets are taken from, in as many rotations as that needs; a quarter of them are in the set.
COORDINATES = 256
BANDS, WIDTH, VALUES = 12, 3, 64
#: Inner bands of WIDTH values; of one value more, each time FURTHER times as many, which keeps the recall.
INNER, FURTHER = 60, 3.6
#: A candidate's least Jaccard similarity. At a cosine of 0.75 fewer than one pair in 10,000 has less (mean 0.37, standard deviation 0.04).
LEAST_JACCARD = 0.2
#: Groups up to the last size are compared as a whole, together with others of about the same size; those of up to PAIRED records pair by pair, larger ones as products of matrices.
SIZES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 20, 24, 28, 32, 36, 40, 44, 48, 56, 64, 72, 80, 88, 100, 116, 132, 152, 176, 200, 232, 256)
PAIRED = 10
#: Larger groups are compared in blocks of as many records.
BLOCK = 1024
#: Rows and floats that are worked on at once: about what a processor's own cache holds, as tasks share the memory's bandwidth.
ROWS, FLOATS = 1024, 1 << 18
#: Found pairs that wait for being joined.
WAITING = 1 << 17
#: Up to as many records in a task WIDTH values are enough; one more for each 16 times as many.
NARROW_ROWS = 150_000
#: Small buckets share parts of about PART_ROWS records; buckets of more than BUCKET_ROWS are cut into blocks.
PART_ROWS, BUCKET_ROWS = 120_000, 600_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Scheme:
    """Rotations and random orders of the tokens; the same for every run."""

    def __init__(self, dim: int):
        rng = np.random.default_rng(11)
        rotations = -(-COORDINATES // dim)
        self.rotation = np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(rotations)], 1).astype(np.float32)
        self.universe = 2 * dim * rotations
        self.size = max(1, dim * rotations // 4)
        orders = np.stack([rng.permutation(self.universe) for _ in range(BANDS * (1 + VALUES))]).astype(np.uint16)
        # a row for each token with its ranks in all orders of a kind, so that one look-up gives them all
        self.of_bands = np.ascontiguousarray(orders[:BANDS].T)
        self.of_values = [np.ascontiguousarray(np.minimum(o, 255).astype(np.uint8).T) for o in orders[BANDS:].reshape(BANDS, VALUES, -1)]

    def tokens(self, x: np.ndarray) -> np.ndarray:
        """The set of each vector: coordinates and signs."""
        y = x @ self.rotation
        size = np.abs(y)
        least = np.partition(size, y.shape[1] - self.size, axis=1)[:, y.shape[1] - self.size, None]
        chosen = size >= least
        at = np.flatnonzero(chosen)
        if len(at) != len(x) * self.size:  # where several are as large as the least, some are too many
            tied = np.flatnonzero(chosen.sum(1) != self.size)
            chosen[tied] = False
            for i in tied.tolist():
                chosen[i, np.argpartition(-size[i], self.size - 1)[: self.size]] = True
            at = np.flatnonzero(chosen)
        tokens = at.reshape(len(x), self.size) - np.arange(len(x))[:, None] * y.shape[1]
        tokens *= 2
        tokens += y.ravel()[at].reshape(tokens.shape) > 0
        return tokens

    def _least(self, ranks: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The least rank of each row's tokens in each order."""
        across = np.ascontiguousarray(tokens.T)
        out = np.take(ranks, across[0], axis=0)
        other = np.empty_like(out)
        for own in across[1:]:
            np.take(ranks, own, axis=0, out=other, mode="clip")
            np.minimum(out, other, out=out)
        return out

    def bands(self, tokens: np.ndarray) -> np.ndarray:
        """The MinHash of each band, one column for each."""
        return self._least(self.of_bands, tokens)

    def values(self, tokens: np.ndarray, band: int) -> np.ndarray:
        """The further MinHashes of a band, one row for each, as bytes: hardly any least rank is larger."""
        return self._least(self.of_values[band], tokens).T

    def bitmaps(self, tokens: np.ndarray) -> np.ndarray:
        width = -(-self.universe // 64) * 64
        bits = np.zeros(len(tokens) * width, np.uint8)
        bits[tokens + np.arange(len(tokens))[:, None] * width] = 1
        return np.packbits(bits.reshape(len(tokens), width), axis=1).view(np.uint64)

    def bands_of(self, scale: np.ndarray, small: np.ndarray) -> np.ndarray:
        """The MinHashes of 8-bit vectors, a few rows at a time."""
        return np.concatenate([self.bands(self.tokens(small[i : i + ROWS] * scale[i : i + ROWS, None])) for i in range(0, len(small), ROWS)])

    def inner(self, rows: int) -> np.ndarray:
        """The values of each inner band, for a part of as many rows: the width grows with their logarithm."""
        wider = max(0, int(np.ceil(np.log(max(rows, 1) / NARROW_ROWS) / np.log(16))))
        rng = np.random.default_rng(13)
        return np.stack([rng.choice(VALUES, WIDTH + wider, replace=False) for _ in range(int(INNER * FURTHER**wider))])


class Layout:
    """Where the buckets of each band go: ``first`` part and number of ``blocks`` of each; of several blocks, every two share a part."""

    def __init__(self, counts: np.ndarray, part_rows: int, bucket_rows: int):
        self.first = np.zeros(counts.shape, np.int64)
        self.blocks = np.maximum(1, -(-counts // bucket_rows))
        self.parts = 0
        for band in range(len(counts)):
            room = 0
            for value in np.argsort(-counts[band], kind="stable").tolist():
                n, b = int(counts[band, value]), int(self.blocks[band, value])
                if b > 1:
                    self.first[band, value] = self.parts
                    self.parts += b * (b + 1) // 2
                    continue
                if n > room:
                    room, self.parts = max(part_rows, n), self.parts + 1
                self.first[band, value] = self.parts - 1
                room -= n

    def parts_of(self, bands: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(records, bands, parts) that records with these MinHashes go to."""
        n = len(key)
        record, band = np.repeat(np.arange(n), bands.shape[1]), np.tile(np.arange(bands.shape[1]), n)
        first, blocks = self.first[band, bands.ravel()], self.blocks[band, bands.ravel()]
        own = ((key.view(np.uint64) * _MIX >> np.uint64(20)) % blocks.reshape(n, -1).T.astype(np.uint64)).T.ravel().astype(np.int64)
        at = np.repeat(np.arange(len(record)), blocks)
        other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        low, high = np.minimum(own[at], other), np.maximum(own[at], other)
        return record[at], band[at], first[at] + high * (high + 1) // 2 + low


#: key, scale, 8-bit vector and MinHash of the band of each record
_KINDS = (np.int64, np.float32, np.int8, np.uint16)


def _pack(arrays: list[np.ndarray]) -> bytes:
    return b"".join([np.array([a.size for a in arrays], np.int64).tobytes(), *[np.ascontiguousarray(a, k).tobytes() for a, k in zip(arrays, _KINDS)]])


def _unpack(blob: bytes) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(_KINDS))
    out, at = [], 8 * len(_KINDS)
    for n, kind in zip(sizes, _KINDS):
        out.append(np.frombuffer(blob, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _records(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, scales, 8-bit vectors) of the usable vectors, those that the task has not sent yet."""
    seen: set[int] = set()
    for b in batches:
        own = []
        for i in range(0, b.num_rows, ROWS):
            _, x = usable(b.column(0).slice(i, ROWS), dim)
            key, x = keys(x), x.astype(np.float32)
            scale = np.abs(x).max(1) / 127
            own.append((key, scale, np.round(x / scale[:, None]).astype(np.int8)))
        if not own:
            continue
        key, scale, small = (np.concatenate(a) for a in zip(*own))
        _, first = np.unique(key, return_index=True)
        first = first[[k not in seen for k in key[first].tolist()]]
        seen.update(key[first].tolist())
        if len(seen) > 1_000_000:  # forgetting only sends a vector again
            seen.clear()
        if len(first):
            yield key[first], scale[first], small[first]


def _count(scheme: Scheme, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BANDS, scheme.universe), np.int64)
        for _, scale, small in _records(batches, dim):
            bands = scheme.bands_of(scale, small)
            for t in range(BANDS):
                total[t] += np.bincount(bands[:, t], minlength=scheme.universe)
        band, value = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(band, pa.int32()), pa.array(value, pa.int32()), pa.array(total[band, value])], ["band", "value", "n"])

    return run


def _layout(vectors: DataFrame, scheme: Scheme, dim: int, bucket_rows: int) -> Layout:
    """The parts, from exact counts of all buckets: BANDS times the number of tokens at most, whatever the collection."""
    counts = np.zeros((BANDS, scheme.universe), np.int64)
    for r in vectors.mapInArrow(_count(scheme, dim), "band int, value int, n bigint").groupBy("band", "value").agg(F.sum("n").alias("n")).collect():
        counts[r["band"], r["value"]] = r["n"]
    return Layout(counts, min(PART_ROWS, bucket_rows), bucket_rows)


def _emit(scheme: Scheme, layout: Layout, dim: int):
    """Packs the records of a task for the parts, once for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, scale, small in _records(batches, dim):
            bands = scheme.bands_of(scale, small)
            record, band, part = layout.parts_of(bands, key)
            order = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
            blobs = []
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(order)]):
                rows = order[i:j]
                own = record[rows]
                blobs.append(_pack([key[own], scale[own], small[own], bands[own, band[rows]]]))
            yield pa.RecordBatch.from_arrays([pa.array(part[order[edge]], pa.int64()), pa.array(band[order[edge]], pa.int32()), pa.array(blobs, pa.binary())], ["part", "band", "blob"])

    return run


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its connected component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _meet(scheme: Scheme, dim: int, least: float, jaccard: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        band = int(pdf["band"].iloc[0])
        key, scale, small, value = (np.concatenate(x) for x in zip(*map(_unpack, pdf["blob"])))
        key, first = np.unique(key, return_index=True)
        scale, small, value = scale[first], small.reshape(-1, dim)[first], value[first]
        made = []
        for i in range(0, len(key), ROWS):
            tokens = scheme.tokens(small[i : i + ROWS] * scale[i : i + ROWS, None])
            made.append((scheme.bitmaps(tokens), scheme.values(tokens, band)))
        sets, values = np.concatenate([m[0] for m in made]), np.ascontiguousarray(np.concatenate([m[1] for m in made], 1))
        del made
        # a coordinate is off by half a step at most, so a vector by half a step times the root of the width; both vectors count
        error = scale * np.float32(np.sqrt(dim) / 2 * 1.1)

        def verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Whether the sets of pairs have a Jaccard similarity of at least ``jaccard``."""
            out = np.empty(len(a), bool)
            for i in range(0, len(a), 1 << 17):
                common = np.bitwise_count(sets[a[i : i + (1 << 17)]] & sets[b[i : i + (1 << 17)]]).sum(1, dtype=np.int32)
                out[i : i + (1 << 17)] = common >= jaccard * (2 * scheme.size - common)
            return out

        label = np.arange(len(key), dtype=np.int32)
        unsure: list[np.ndarray] = []

        def link(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
            nonlocal label
            bound = error[a] + error[b]
            linked = c >= least + bound
            maybe = ~linked & (c >= least - bound)
            if maybe.any():
                x, y = a[maybe], b[maybe]
                unsure.append(np.unique(np.minimum(x, y).astype(np.uint64) << np.uint64(32) | np.maximum(x, y).astype(np.uint64)))
            if linked.any():
                nodes, index = np.unique(np.concatenate([label[a[linked]], label[b[linked]]]), return_inverse=True)
                half = int(linked.sum())
                to = np.arange(len(key), dtype=np.int32)
                to[nodes] = nodes[components(len(nodes), index[:half], index[half:])]
                label = to[label]

        def join(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
            a, b, c = (np.concatenate(f) for f in zip(*found))
            alike = verified(a, b)
            link(a[alike], b[alike], c[alike])

        low = np.float32(least - 2 * error.max(initial=0))
        # the scale of a second record that asks for the least
        easiest = scale.max() if low > 0 else scale.min()
        pairs_of = {}
        for m in range(2, PAIRED + 1):
            second = np.concatenate([np.arange(d, m) for d in range(1, m)])
            pairs_of[m] = second - np.repeat(np.arange(1, m), np.arange(m - 1, 0, -1)), second

        def near(members: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(a, b, cosine) of the pairs of different clusters in groups (a row each, the first ``size`` of it) that may be links."""
            groups, most = members.shape
            x = np.take(small, members.ravel(), axis=0, mode="clip").astype(np.float32).reshape(groups, most, dim)
            own = label[members]
            # products of 8-bit vectors, first held against what any second record would ask for
            enough = low / (scale[members] * easiest)
            if most <= PAIRED:  # no padding: each such size is a class
                first, second = pairs_of[most]
                c = np.empty((groups, len(first)), np.float32)
                for d, i in zip(range(1, most), np.cumsum([0, *range(most - 1, 1, -1)]).tolist()):
                    np.vecdot(x[:, :-d], x[:, d:], out=c[:, i : i + most - d])
                hit = np.flatnonzero((c >= np.take(enough, first, axis=1)) & (np.take(own, first, axis=1) != np.take(own, second, axis=1)))
                g = hit // len(first)
                pair = hit - g * len(first)
                a, b = members[g, first[pair]], members[g, second[pair]]
            else:
                c = np.matmul(x, x.transpose(0, 2, 1))
                alike = c >= enough[:, :, None]
                alike &= own[:, :, None] != own[:, None, :]
                hit = np.flatnonzero(alike)
                line = hit // most
                g = line // most
                row, column = line - g * most, hit - line * most
                real = (row < column) & (column < size[g])
                hit, g = hit[real], g[real]
                a, b = members[g, row[real]], members[g, column[real]]
            c = c.ravel()[hit] * scale[a] * scale[b]
            real = c >= low
            return a[real], b[real], c[real]

        bits = np.uint64(int(len(key)).bit_length())
        place = np.arange(len(key), dtype=np.uint64)
        for t, columns in enumerate(scheme.inner(len(key))):
            mixed = value.astype(np.uint64)
            for column in columns:
                mixed <<= np.uint64(8)
                mixed |= values[column]
            # sorted together with the places, which is quicker than sorting places; hashed where they don't fit beside them: equal hashes of different bands only add candidates
            if 16 + 8 * len(columns) + int(bits) > 64:
                mixed *= _MIX
                mixed >>= bits
            mixed <<= bits
            mixed |= place
            mixed.sort()
            at = (mixed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            mixed >>= bits
            begin = np.flatnonzero(np.append(True, mixed[1:] != mixed[:-1])) if len(mixed) else np.zeros(0, np.int64)
            size = np.diff(np.append(begin, len(mixed)))
            # groups of one record or one cluster have nothing to find
            labels = label[at]
            open_ = (size > 1) & (np.minimum.reduceat(labels, begin) != np.maximum.reduceat(labels, begin)) if len(begin) else np.zeros(0, bool)
            if not open_.any():
                continue
            # a group's pairs from one product of matrices, many groups of about one size at once
            groups = np.flatnonzero(open_)
            groups = groups[np.argsort(np.minimum(size[groups], SIZES[-1] + 1).astype(np.uint16), kind="stable")]
            edges = np.searchsorted(size[groups], SIZES, "right").tolist()
            waiting, count = [], 0
            for k, most in enumerate(SIZES[1:]):
                own = groups[edges[k] : edges[k + 1]]
                step = max(1, FLOATS // (most * (dim + most)))
                for i in range(0, len(own), step):
                    part = own[i : i + step]
                    # a group's last record fills its row up
                    rows = begin[part, None] + np.arange(most)
                    np.minimum(rows, (begin[part] + size[part] - 1)[:, None], out=rows)
                    waiting.append(near(at[rows], size[part]))
                    count += len(waiting[-1][0])
                    if count >= WAITING:
                        join(waiting)
                        waiting, count = [], 0
            if count:
                join(waiting)
            wide = groups[edges[-1] :]
            large = [at[i : i + m] for i, m in zip(begin[wide].tolist(), size[wide].tolist())]
            for members in large:
                # the first by a hash that differs with the inner band
                leader = members[((key[members].view(np.uint64) * _MIX) ^ np.uint64((t + 1) * 0x51ED270B)).argmin()]
                b = members[label[members] != label[leader]]
                c = np.concatenate([small[b[i : i + BLOCK]].astype(np.float32) @ small[leader].astype(np.float32) for i in range(0, len(b), BLOCK)] or [np.zeros(0, np.float32)])
                c *= scale[b] * scale[leader]
                b, c = b[c >= low], c[c >= low]
                join([(np.full(len(b), leader), b, c)])
                # then the records outside the largest cluster with all of the group
                _, own, sizes = np.unique(label[members], return_inverse=True, return_counts=True)
                outside = members[own != sizes.argmax()]
                if not len(outside):
                    continue
                for i in range(0, len(members), BLOCK):
                    y = members[i : i + BLOCK]
                    others = small[y].astype(np.float32) * scale[y, None]
                    for j in range(0, len(outside), BLOCK // 4):
                        x = outside[j : j + BLOCK // 4]
                        c = (small[x].astype(np.float32) * scale[x, None]) @ others.T
                        alike = c >= low
                        alike &= label[x, None] != label[y]
                        hit = np.flatnonzero(alike)
                        if len(hit):
                            join([(x[hit // len(y)], y[hit % len(y)], c.ravel()[hit])])
        pair = np.unique(np.concatenate(unsure)) if unsure else np.zeros(0, np.uint64)
        a, b = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        apart = label[a] != label[b]
        inside = label != np.arange(len(key))
        return pd.DataFrame({
            "a": np.concatenate([key[inside], key[a[apart]]]),
            "b": np.concatenate([key[label[inside]], key[b[apart]]]),
            "sure": np.concatenate([np.ones(int(inside.sum()), bool), np.zeros(int(apart.sum()), bool)]),
        })

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``): the smallest node of the component of each node in ``edges`` (a, b), by large and small stars.

    Each round links every node to the smallest of its neighbours; the number of rounds grows with the logarithm of the
    longest chain. Every round is written down, so the plan never grows.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = durable(small.select("e.u", "e.v").where("u <> v").distinct())
        # done when every node points to one smaller node, and none of those points further
        state = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        open_ = state.where("n > 1").limit(1).count() or after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        now = after
        if not open_:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _merge(reports: DataFrame) -> DataFrame:
    """(key, label) from what the tasks report: (a, b), b being the first of a's part of a cluster. A record is reported at most once by each task that got it."""
    heads = reports.groupBy("a").agg(F.collect_set("b").alias("heads"))
    heads = written(heads.select("a", F.array_min("heads").alias("head"), "heads"))
    more = heads.where(F.size("heads") > 1).select(F.explode("heads").alias("a"), F.col("head").alias("b"))
    # a head that another task has under a head of its own
    under = heads.select("a", F.col("head").alias("b")).join(heads.select(F.explode("heads").alias("a")).distinct(), "a", "left_semi")
    labels = connected(more.unionByName(under))
    every = heads.select("a", "head").unionByName(heads.select(F.explode("heads").alias("a")).distinct().select("a", F.col("a").alias("head")))
    out = every.join(labels.select(F.col("node").alias("head"), "label"), "head", "left").select("a", F.coalesce("label", "head").alias("label"))
    return out.groupBy("a").agg(F.min("label").alias("label")).withColumnRenamed("a", "key")


def _labels(rows: DataFrame, dim: int, least: float, jaccard: float, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """((key, label) of the clusters of two keys and more, (key, id, vector) of all usable rows)."""
    scheme = Scheme(dim)
    vectors = rows.select("__vec")
    packed = vectors.mapInArrow(_emit(scheme, _layout(vectors, scheme, dim, bucket_rows), dim), "part bigint, band int, blob binary")
    reports = written(packed.groupBy("part").applyInPandas(_meet(scheme, dim, least, jaccard), "a bigint, b bigint, sure boolean"))
    labels = durable(_merge(reports.where("sure").select("a", "b")))
    unsure = reports.where("NOT sure").select("a", "b").distinct()
    la, lb = labels.select(F.col("key").alias("a"), F.col("label").alias("la")), labels.select(F.col("key").alias("b"), F.col("label").alias("lb"))
    unsure = unsure.join(la, "a", "left").join(lb, "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")).where("la <> lb")
    unsure = durable(unsure)
    m = members_and_vectors(rows, "__id", "__vec", dim, unsure.select("a", "b"))
    late = unsure.join(exact_cosines(unsure.select("a", "b"), m).where(F.col("cosine") >= least), ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    late = durable(late)
    if late.limit(1).count():
        merged = connected(late)
        labels = labels.unionByName(late.select(F.explode(F.array("a", "b")).alias("key")).distinct().select("key", F.col("key").alias("label")))
        labels = labels.groupBy("key").agg(F.min("label").alias("label"))
        labels = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("key", F.coalesce("to", "label").alias("label"))
    return labels, m


def similarity_clusters(df: DataFrame, id_col: str, vec_col: str, dim: int, least: float, least_size: int = 3, jaccard: float = LEAST_JACCARD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(cluster_id, id, size) of every row in a cluster of ``least_size`` rows or more; ``cluster_id`` is the smallest id in it.

    Two rows are in one cluster if their vectors' cosine is at least ``least`` or a chain of such pairs joins them. Rows
    count if their vectors have ``dim`` finite elements that aren't all zero; rows with the same id are one row, rows without
    id none; ids must be strings. Approximate: a link is missed where two sets share no band, or in no shared band an inner one, or where their Jaccard similarity is below
    ``jaccard``. ``bucket_rows`` bounds the records of a task and changes no result. Other columns aren't read.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(vec_col).alias("__vec"))
    labels, m = _labels(rows, dim, least, jaccard, bucket_rows)
    ids = m.select("key", "id").distinct().join(labels, "key", "left").select("id", F.coalesce("label", "key").alias("label"))
    sizes = ids.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("cluster_id")).where(F.col("size") >= least_size)
    return join_on_key(ids, sizes, "label", "inner").select("cluster_id", "id", "size")


#: Medoids that a cluster is split around in one round, at most.
MEDOIDS = 32
#: Centres or medoids that are broadcast; more are joined with care for large clusters.
BROADCAST_ROWS = 20_000


def _per_cluster(members: DataFrame, facts: DataFrame) -> DataFrame:
    if facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return members.join(F.broadcast(facts), "cluster_id")
    return join_on_key(members, facts, "cluster_id", "inner")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit(v: Column) -> Column:
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / norm)


def _centres(members: DataFrame, dim: int) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(dim)]).alias("centre"), F.count(F.lit(1)).alias("size"))


def _with_vectors(df: DataFrame, clusters: DataFrame, id_col: str, vec_col: str, dim: int, *text: Column) -> DataFrame:
    rows = df.where(F.col(id_col).isNotNull() & (F.size(vec_col) == dim)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), *text)
    rows = rows.join(clusters.select("cluster_id", "id"), "id").dropDuplicates(["id"])
    return durable(rows.select("cluster_id", "id", _unit(F.col("v")).alias("v"), *(["__text"] if text else [])))


def described(df: DataFrame, clusters: DataFrame, id_col: str, vec_col: str, dim: int, text_col: str, typical: int = 3) -> DataFrame:
    """(cluster_id, size, cohesion, typical_ids, typical_texts) of each cluster of :func:`similarity_clusters`.

    A member's degree is the sum of its cosines to all members, which is its inner product with their sum; the typical
    members are those of highest degree, of equals the smaller id first. ``cohesion`` is
    the length of the mean vector: the root of the mean of all pairs' cosines. Null texts come out as empty ones.
    """
    members = _with_vectors(df, clusters, id_col, vec_col, dim, F.col(text_col).alias("__text"))
    centres = _centres(members, dim)
    m = _per_cluster(members, centres).withColumn("degree", F.round(_dot("v", "centre"), 9))
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.col("degree").desc(), "id"))
    top = m.withColumn("k", place).where(F.col("k") <= typical).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("k", "id", F.coalesce("__text", F.lit("")).alias("t")))).alias("t"))
    return top.join(centres, "cluster_id").select(
        "cluster_id", "size", F.round(F.sqrt(_dot("centre", "centre")), 6).alias("cohesion"), F.transform("t", lambda x: x["id"]).alias("typical_ids"), F.transform("t", lambda x: x["t"]).alias("typical_texts")
    )


def _apart(least: float):
    """Of a cluster's candidates, in order of degree, those that no earlier one is near to; numbered from 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        near = np.stack(pdf["v"].to_list()) @ np.stack(pdf["v"].to_list()).T >= least
        kept: list[int] = []
        for i in range(len(pdf)):
            if not near[i, kept].any():
                kept.append(i)
        own = pdf.iloc[kept]
        return pd.DataFrame({"cluster_id": own["cluster_id"].to_numpy(), "k": np.arange(1, len(kept) + 1, dtype=np.int32), "medoid": own["id"].to_numpy(), "mv": own["v"].to_numpy()})

    return run


def split_loose(df: DataFrame, clusters: DataFrame, id_col: str, vec_col: str, dim: int, least: float, medoids: int = MEDOIDS) -> DataFrame:
    """(cluster_id, medoid, id): the loose clusters, split around their medoids.

    In a round each cluster's ``medoids`` members of highest degree are candidates, of equal degrees the smaller id first; those that no earlier candidate has a cosine of ``least`` to are
    medoids. The first of them takes all members of at least that cosine, then the next, and what no medoid takes goes on to the next round, until none is
    left. All clusters take a step at once, so rounds grow with the parts of the loosest cluster divided by ``medoids``. A cluster is loose if its first medoid doesn't take all.
    """
    left = _with_vectors(df, clusters, id_col, vec_col, dim)
    parts: list[DataFrame] = []
    loose = None
    while left.limit(1).count():
        m = _per_cluster(left, _centres(left, dim).select("cluster_id", "centre")).withColumn("degree", F.round(_dot("v", "centre"), 9))
        place = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.col("degree").desc(), "id"))
        top = m.withColumn("k", place).where(F.col("k") <= medoids).select("cluster_id", "k", "id", "v")
        chosen = durable(top.groupBy("cluster_id").applyInPandas(_apart(least), "cluster_id string, k int, medoid string, mv array<double>"))
        near = _per_cluster(left, chosen).where((F.col("id") == F.col("medoid")) | (_dot("v", "mv") >= least))
        part = durable(near.groupBy("cluster_id", "id").agg(F.min(F.struct("k", "medoid")).alias("t")).select("cluster_id", "t.medoid", "id", "t.k"))
        left = durable(left.join(part.select("cluster_id", "id"), ["cluster_id", "id"], "left_anti"))
        if loose is None:
            loose = left.select("cluster_id").unionByName(part.where("k > 1").select("cluster_id")).distinct()
        parts.append(part.select("cluster_id", "medoid", "id"))
    if not parts:
        return left.select("cluster_id", F.col("id").alias("medoid"), "id")
    out = parts[0].join(loose, "cluster_id", "left_semi")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
