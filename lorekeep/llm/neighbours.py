"""Problem 2: the most similar vectors of every vector.

Vectors are spread over cells, by the nearest of some centres. In its cell a vector is kept as one bit for each dimension
of its randomly rotated residual, with correction scalars; from these the inner product with any query is estimated
without bias and with an error bound (the RaBitQ estimator). A query looks into its ``PROBES`` nearest cells; only where
the upper bound reaches both the asked similarity and the k-th best lower bound so far is the vector kept. What is kept is
estimated again with 8 bits a coordinate on both sides, and cut by the k-th best of the cell and then of all cells looked into;
reranking computes the exact cosine once for each pair that is left.

There are as many centres as make finding a query's cells and looking through them cost the same: the root of ``PROBES`` times the
number of vectors. They are fitted on a bounded sample, but every vector is indexed. The shuffle moves codes, not
vectors; equal vectors of a task are one record; cells that the sample shows to be large are split into blocks of vectors and blocks of queries,
each of which meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.operators.skew import join_on_key
from lorekeep.session import durable, written

#: Centres are fitted on about PER_CENTRE vectors each, in all on at least LEAST_SAMPLE and at most MOST_SAMPLE.
PER_CENTRE, LEAST_SAMPLE, MOST_SAMPLE = 16, 32_768, 262_144
PROBES = 6
LEAST_CELL = 64
#: A block of a cell has about as many vectors, and about as many queries.
BLOCK, QUERIES = 16_384, 131_072
#: Standard deviations in the error bound (the value of the method's paper).
EPSILON = 1.9
#: Standard deviations in the bound of the 8-bit estimates, whose rounding errors a random rotation makes independent.
ROUNDING = 6
KEPT_BITS = 1 << 24
_MIX = np.uint64(0x9E3779B97F4A7C15)


def usable(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their vectors scaled to length 1) of a list column: those of ``dim`` finite elements that aren't all zero."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(n == dim)
    x = np.asarray(lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), dim)
    norm = np.linalg.norm(x, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    return rows[ok], x[ok] / norm[ok, None]


def keys(x: np.ndarray) -> np.ndarray:
    """A 64-bit key of each vector; equal vectors have equal keys."""
    bits = np.ascontiguousarray(x.astype(np.float32) + np.float32(0)).view(np.uint32).astype(np.uint64)
    weights = np.random.default_rng(5).integers(1, 2**63, x.shape[1]).astype(np.uint64) | np.uint64(1)
    mixed = (bits + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(32)
    return ((mixed * weights).sum(1, dtype=np.uint64) * _MIX).view(np.int64)


def centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Centres of length 1, by spherical k-means from a random start; dense regions get more of them."""
    c = sample[np.random.default_rng(1).choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        order = np.argsort(near, kind="stable")
        own, begin = np.unique(near[order], return_index=True)
        c = c.copy()
        c[own] = np.add.reduceat(sample[order], begin, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def centres_for(rows: int) -> int:
    """The root of PROBES times the rows, which balances finding cells and looking through them; never fewer than LEAST_CELL vectors a cell."""
    return max(1, int(min(np.sqrt(PROBES * rows), rows / LEAST_CELL)))


class Index:
    """Centres, rotation and the number of blocks of each cell's vectors and queries."""

    def __init__(self, sample: np.ndarray, rows: int, dim: int):
        sample = sample.astype(np.float32)
        k = min(centres_for(rows), max(1, len(sample) // 4))
        self.centres = centres(sample, k) if len(sample) else np.zeros((1, dim), np.float32)
        self.rotation = np.linalg.qr(np.random.default_rng(2).standard_normal((dim, dim)))[0].astype(np.float32)
        self.rotated = self.centres @ self.rotation
        near = np.concatenate([(sample[i : i + 4096] @ self.centres.T).argmax(1) for i in range(0, len(sample), 4096)] or [np.zeros(0, int)])
        load = np.bincount(near, minlength=k) * (rows / max(1, len(sample)))
        self.blocks = np.maximum(1, np.ceil(load / BLOCK)).astype(np.int64)
        # the queries of a cell are those of its own vectors and of as many neighbouring cells
        self.query_blocks = np.maximum(1, np.ceil(load * PROBES / QUERIES)).astype(np.int64)

    def probes(self, x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells, inner products with their centres) of the p nearest cells of each row, nearest first."""
        sims = x @ self.centres.T
        p = min(p, sims.shape[1])
        cells = np.argpartition(-sims, p - 1, axis=1)[:, :p] if p < sims.shape[1] else np.tile(np.arange(p), (len(x), 1))
        own = np.take_along_axis(sims, cells, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        return np.take_along_axis(cells, order, 1), np.take_along_axis(own, order, 1)


def fit(df: DataFrame, vec_col: str, dim: int) -> Index:
    """The index of ``vec_col``, from a sample of at most MOST_SAMPLE of its vectors (those whose hashes are small enough)."""
    v = df.where(F.size(vec_col) == dim).select(vec_col)
    n = v.count()
    most = int(np.clip(PER_CENTRE * centres_for(n), LEAST_SAMPLE, MOST_SAMPLE))
    parts = max(1, 1_000_000 * most * 9 // 10 // max(n, 1))
    got = v.where(F.pmod(F.xxhash64(vec_col), F.lit(1_000_000)) < parts).limit(most).toArrow()
    _, x = usable(got.column(0).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float32())), dim)
    return Index(x, n, dim)


def _emit(index: Index, dim: int, probes: int):
    """Packs a task's records for the blocks of cells: codes in their own cell, queries (rows that are asked for) in all that they look into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            rows, x = usable(b.column(0), dim)
            key, asked = keys(x), b.column(1).fill_null(False).to_numpy(zero_copy_only=False)[rows]
            # one of equal vectors, one that is asked for if there is one
            order = np.lexsort((~asked, key))
            first = order[np.flatnonzero(np.append(True, np.diff(key[order]) != 0))] if len(key) else order
            first = first[[k not in seen and (k[0], True) not in seen for k in zip(key[first].tolist(), asked[first].tolist())]]
            seen.update(zip(key[first].tolist(), asked[first].tolist()))
            if len(seen) > 1_000_000:  # forgetting only sends a vector again
                seen.clear()
            if not len(first):
                continue
            key, x, asked = key[first], x[first].astype(np.float32), np.flatnonzero(asked[first])
            cells, sims = index.probes(x, 1)
            q_cells, q_sims = index.probes(x[asked], probes)
            turned = x @ index.rotation
            home = cells[:, 0]
            residual = turned - index.rotated[home]
            length = np.linalg.norm(residual, axis=1)
            factor = np.abs(residual).sum(1) / np.maximum(length, 1e-12) / np.sqrt(np.float32(dim))
            codes = np.packbits(residual > 0, axis=1)
            scale = np.abs(turned).max(1) / 127
            small = np.round(turned / scale[:, None]).astype(np.int8)
            block = (key.view(np.uint64) % index.blocks[home].astype(np.uint64)).astype(np.int64)
            n = len(key)
            # queries, once for each block of each cell
            at = np.repeat(asked, q_cells.shape[1])
            cell, sim = q_cells.ravel(), q_sims.ravel()
            times = index.blocks[cell]
            at, cell_q, sim_q = np.repeat(at, times), np.repeat(cell, times), np.repeat(sim, times)
            block_q = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            wide = index.query_blocks
            block_q = block_q * wide[cell_q] + ((key[at].view(np.uint64) >> np.uint64(40)) % wide[cell_q].astype(np.uint64)).astype(np.int64)
            # vectors, once for each block of queries
            copies = wide[home]
            own = np.repeat(np.arange(n), copies)
            block = block[own] * copies[own] + np.arange(len(own)) - np.repeat(np.cumsum(copies) - copies, copies)
            cell_all, block_all = np.append(home[own], cell_q), np.append(block, block_q)
            order = np.lexsort((block_all, cell_all))
            cell_all, block_all = cell_all[order], block_all[order]
            edge = np.flatnonzero(np.append(True, (np.diff(cell_all) != 0) | (np.diff(block_all) != 0)))
            blobs = []
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(order)]):
                rows = order[i:j]
                d, q = own[rows[rows < len(own)]], rows[rows >= len(own)] - len(own)
                a = at[q]
                arrays = [key[d], np.stack([length[d], factor[d], sims[d, 0], scale[d]], 1), codes[d], small[d], key[a], np.stack([scale[a], sim_q[q]], 1), small[a]]
                blobs.append(_pack(arrays))
            yield pa.RecordBatch.from_arrays([pa.array(cell_all[edge], pa.int64()), pa.array(block_all[edge], pa.int64()), pa.array(blobs, pa.binary())], ["cell", "block", "blob"])

    return run


_KINDS = (np.int64, np.float32, np.uint8, np.int8, np.int64, np.float32, np.int8)


def _pack(arrays: list[np.ndarray]) -> bytes:
    return b"".join([np.array([a.size for a in arrays], np.int64).tobytes(), *[np.ascontiguousarray(a, k).tobytes() for a, k in zip(arrays, _KINDS)]])


def _unpack(blob: bytes) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(_KINDS))
    out, at = [], 8 * len(_KINDS)
    for n, kind in zip(sizes, _KINDS):
        out.append(np.frombuffer(blob, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def estimates(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray, sims: np.ndarray, rotated_centre: np.ndarray, centre_norm2: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, error bounds) of the inner products of queries (rows) with coded vectors (columns).

    ``codes`` are the residuals' signs as +-1, ``scalars`` hold the residual's length, its inner product with the code,
    and the vector's with the centre; ``sims`` the queries' inner products with the centre.
    """
    dim = codes.shape[1]
    residual = queries - rotated_centre
    factor = np.maximum(scalars[:, 1], 1e-6)
    raw = (residual @ codes.T) / np.sqrt(np.float32(dim))
    estimate = raw * (scalars[:, 0] / factor) + sims[:, None] + scalars[:, 2] - np.float32(centre_norm2)
    spread = scalars[:, 0] * np.sqrt(np.maximum(1 - factor**2, 0)) / factor * EPSILON / np.sqrt(dim - 1)
    return estimate, np.linalg.norm(residual, axis=1)[:, None] * spread


def _kth(low: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -2 where there are fewer."""
    return -np.partition(-low, k - 1, axis=1)[:, k - 1 : k] if low.shape[1] >= k else np.full((len(low), 1), -2, np.float32)


def _meet(index: Index, dim: int, k: int, least: float):
    """Candidates ``b`` of queries ``a`` within a block of a cell, with bounds of their cosines."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iloc[0])
        key, scalars, codes, own, qkey, qscalars, small = (np.concatenate(x) for x in zip(*map(_unpack, pdf["blob"])))
        scalars, codes, own, qscalars, small = scalars.reshape(-1, 4), codes.reshape(len(key), (dim + 7) // 8), own.reshape(-1, dim), qscalars.reshape(-1, 2), small.reshape(-1, dim)
        key, first = np.unique(key, return_index=True)
        scalars, scale = scalars[first, :3], scalars[first, 3]
        signs = np.unpackbits(codes[first], axis=1, count=dim).astype(np.float32) * 2 - 1
        own = own[first].astype(np.float32) * scale[:, None]
        qkey, first = np.unique(qkey, return_index=True)
        qscalars, small = qscalars[first], small[first]
        centre2 = float((index.centres[cell] ** 2).sum())
        a, b, lows, highs = [qkey[:0]], [key[:0]], [np.zeros(0, np.float32)], [np.zeros(0, np.float32)]
        step = max(1, 4_000_000 // max(1, len(key)))
        for i in range(0, len(qkey), step):
            q = small[i : i + step].astype(np.float32) * qscalars[i : i + step, :1]
            e, bound = estimates(signs, scalars, q, qscalars[i : i + step, 1], index.rotated[cell], centre2)
            bound += np.float32(2e-3)  # of the queries' rounding
            itself = key == qkey[i : i + step, None]
            low = e - bound
            low[itself] = -2
            kept = (e + bound >= np.maximum(_kth(low, k), np.float32(least))) & ~itself
            e = q @ own.T
            bound = np.sqrt(qscalars[i : i + step, :1] ** 2 + scale**2) * np.float32(ROUNDING / np.sqrt(12))
            low = np.where(kept, e - bound, np.float32(-2))
            x, y = np.nonzero(kept & (e + bound >= np.maximum(_kth(low, k), np.float32(least))))
            a.append(qkey[i + x])
            b.append(key[y])
            lows.append(low[x, y])
            highs.append((e + bound)[x, y])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "low": np.concatenate(lows), "high": np.concatenate(highs)})

    return run


def _filter_bits(pairs: DataFrame) -> np.ndarray:
    """A fixed-size bit table of the keys in ``pairs``."""

    def bits(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(KEPT_BITS, bool)
        for pdf in it:
            for c in ("a", "b"):
                own[pdf[c].to_numpy().view(np.uint64) % np.uint64(KEPT_BITS)] = True
        packed = np.packbits(own)
        at = np.flatnonzero(packed)
        yield pd.DataFrame({"at": at.astype(np.int32), "byte": packed[at].astype(np.int16)})

    kept = np.zeros(KEPT_BITS // 8, np.uint8)
    filled = pairs.mapInPandas(bits, "at int, byte smallint").groupBy("at").agg(F.bit_or("byte").alias("byte")).toPandas()
    kept[filled["at"].to_numpy(np.int64)] = filled["byte"].to_numpy(np.uint8)
    return kept


def members_and_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, pairs: DataFrame) -> DataFrame:
    """(key, id, vector): every usable row; its vector, of the input's type, only where a candidate pair may name its key."""
    kept = df.sparkSession.sparkContext.broadcast(_filter_bits(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(kept.value).view(bool)
        for b in batches:
            rows, x = usable(b.column(1), dim)
            key = keys(x)
            wanted = maybe[key.view(np.uint64) % np.uint64(KEPT_BITS)]
            offsets = np.append(0, np.cumsum(np.where(wanted, dim, 0))).astype(np.int32)
            vectors = pa.ListArray.from_arrays(offsets, b.column(1).take(pa.array(rows[wanted])).flatten())
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(rows)), vectors], ["key", "id", "vector"])

    return written(df.select(id_col, vec_col).mapInArrow(run, f"key bigint, id string, vector {df.schema[vec_col].dataType.simpleString()}"))


def exact_cosines(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, cosine) of key pairs, each computed once in double precision."""
    one = rows.where(F.size("vector") > 0).groupBy("key").agg(F.first("vector").alias("vector"))
    both = pairs.join(one.select(F.col("key").alias("a"), F.col("vector").alias("va")), "a").join(one.select(F.col("key").alias("b"), F.col("vector").alias("vb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.asarray(b.column(i).flatten(), np.float64).reshape(b.num_rows, -1) for i in (2, 3))
            x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", x, y))], ["a", "b", "cosine"])

    return both.select("a", "b", "va", "vb").mapInArrow(run, "a bigint, b bigint, cosine double")


def most_similar(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int, least: float = -1.0, probes: int = PROBES, asked: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, neighbour, cosine, rank): for each row with a usable vector (and an id for which ``asked`` holds) its ``k`` most similar other rows, of all, of cosine ``least`` or more.

    Usable: ``dim`` finite elements, not all zero. Rows with the same id are one row, rows without id none; ids must be
    strings. Of equally similar rows the smaller id comes first. Approximate: a neighbour is missed where no cell holds
    one of the two and is looked into by the other: more ``probes`` find more. Other columns aren't read; no usable vector, no rows.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(vec_col).alias("__vec"))
    index = fit(rows, "__vec", dim)
    asked = asked or (lambda i: F.lit(True))
    cells = rows.select("__vec", asked(F.col("__id")).alias("__asked")).mapInArrow(_emit(index, dim, probes), "cell bigint, block bigint, blob binary")
    met = cells.groupBy("cell", "block").applyInPandas(_meet(index, dim, k, least), "a bigint, b bigint, low float, high float")
    # what can still be among a query's k best of all its cells
    met = met.withColumn("place", F.row_number().over(W.partitionBy("a").orderBy(F.col("low").desc())))
    met = met.withColumn("kth", F.max(F.when(F.col("place") == k, F.col("low"))).over(W.partitionBy("a"))).where(F.col("high") >= F.coalesce("kth", F.lit(-2.0)))
    pairs = durable(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    m = members_and_vectors(rows, "__id", "__vec", dim, pairs)
    near = exact_cosines(pairs, m).where(F.col("cosine") >= least)
    near = durable(near.select("a", "b", "cosine").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")))
    near = _first(near, "a", [F.col("cosine").desc(), F.col("b")], k)
    ids = m.select("key", "id").distinct()
    # of equal vectors only the k + 1 smallest ids can be anyone's neighbours, so a key's candidates are few
    first = _first(ids, "key", [F.col("id")], k + 1).select("key", F.col("id").alias("neighbour"))
    other = near.join(first.withColumnRenamed("key", "b"), "b").select(F.col("a").alias("key"), "neighbour", "cosine")
    both = other.unionByName(first.select("key", "neighbour", F.lit(1.0).alias("cosine")))
    lists = durable(both.groupBy("key").agg(F.collect_list(F.struct("cosine", "neighbour")).alias("all")))
    each = join_on_key(ids.where(asked(F.col("id"))), lists, "key", "inner").select("id", F.explode("all").alias("n")).select("id", "n.neighbour", "n.cosine")
    return _first(each.where(F.col("id") != F.col("neighbour")), "id", [F.col("cosine").desc(), F.col("neighbour")], k, "rank")


def _first(df: DataFrame, key: str, order: list, k: int, place: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key; Spark cuts each key to k rows in every task before the shuffle."""
    df = df.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("__k") <= k)
    return df.withColumnRenamed("__k", place) if place else df.drop("__k")
