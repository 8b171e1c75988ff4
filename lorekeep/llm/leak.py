"""Problem 7: evaluation texts in a corpus.

Greedy string tiling: rolling (Karp-Rabin) hashes of every n consecutive words of a document are looked up among those of
the items, which gives seeds; seeds on one diagonal join into maximal common stretches, and the longest stretches are
marked again and again, never over words already marked. Passages that were reordered are so found one by one, and the
share of an item's words that are marked is its coverage.

The corpus is never shuffled: the items are a stated set, handled in blocks of at most ``BLOCK_WORDS`` words, and each
task gets one block's hashes. Every block reads the corpus once.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.text_runs import LETTER, NUMBER, Runs, chunks, windows

#: Words that must agree in a row; an item of fewer words must occur wholly.
WORDS = 12
#: Words of items that a task holds at once; a stated set of more takes another pass over the corpus for each further block.
BLOCK_WORDS = 2_000_000
#: Words of a tile and share of an item for passages that were reordered.
TILE, COVERAGE = 6, 0.5
_FILTER_BITS = 20
_AWAY = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts, lower-cased, as hashes."""

    def __init__(self, texts: list[str]):
        self.runs = Runs([t.lower() for t in texts])
        self.starts, self.ends = self.runs.spans((self.runs.bits & (LETTER | NUMBER)) > 0)
        self.hashes = self.runs.hashes(self.starts, self.ends)
        self.upto = np.searchsorted(self.starts, self.runs.ends)
        self.first = np.append(0, self.upto[:-1])

    def strings(self, a: int, b: int) -> list[str]:
        return [self.runs.text[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]


class Seeds:
    """Rolling hashes of a block of items, for each window length that the items need."""

    def __init__(self, items: list[tuple], n: int):
        self.ids = [i for i, _ in items]
        w = Words([t or "" for _, t in items])
        self.hashes = [w.hashes[a:b] for a, b in zip(w.first, w.upto)]
        self.words = [w.strings(a, b) for a, b in zip(w.first.tolist(), w.upto.tolist())]
        by_length = defaultdict(list)
        for k, h in enumerate(self.hashes):
            if len(h):
                by_length[min(n, len(h))].append(k)
        self.tables = {}
        for length, own in by_length.items():
            hashes = [windows(self.hashes[k], length) for k in own]
            item = np.repeat(own, [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes])
            flat = np.concatenate(hashes)
            before, after = runs(flat, item)
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[flat & np.uint64((1 << _FILTER_BITS) - 1)] = True
            self.tables[length] = [maybe]
            for some, away in ((np.arange(len(flat)), before), (np.flatnonzero(before + after), after)):
                key = flat[some] + away[some].astype(np.uint64) * _AWAY
                order = some[np.argsort(key, kind="stable")]
                self.tables[length].append((np.sort(key), item[order], place[order], before[order]))

    def matches(self, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(window length, texts, items, positions in the text, positions in the item) of the seeds.

        Where one window repeats itself, as in a text of one word, only seeds equally far from the begin, or from the end, of both runs
        count: the longest common stretch is among them, and their number doesn't grow with the product of the runs.
        """
        for length, (maybe, *tables) in self.tables.items():
            h = windows(w.hashes, length)
            at = np.flatnonzero(maybe[h & np.uint64((1 << _FILTER_BITS) - 1)])
            at = at[np.searchsorted(w.upto, at, "right") == np.searchsorted(w.upto, at + length - 1, "right")]
            text = np.searchsorted(w.upto, at, "right")
            # positions that are no neighbours, or in two texts, are of different runs
            before, after = runs(h[at], (at - np.arange(len(at))) * (len(w.upto) + 1) + text)
            found = []
            for some, away, (keys, item, place, item_before) in ((np.arange(len(at)), before, tables[0]), (np.flatnonzero(before + after), after, tables[1])):
                key = h[at[some]] + away[some].astype(np.uint64) * _AWAY
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                n = high - low
                index = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                own = np.repeat(some, n)
                if found:  # those equally far from the begin were found already
                    index, own = index[item_before[index] != before[own]], own[item_before[index] != before[own]]
                found.append((text[own], item[index], at[own] - w.first[text[own]], place[index]))
            yield length, *(np.concatenate(x) for x in zip(*found))


def runs(hashes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of some windows in a row how many equal ones of its group come directly before and after it."""
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (group[1:] != group[:-1])) if len(hashes) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(hashes)))
    before = np.arange(len(hashes)) - np.repeat(begin, size)
    return before, np.repeat(size, size) - 1 - before


def tiles(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: from maximal common stretches (place in a, place in b, length), longest first, those of at least ``least`` words that overlap no earlier one; a stretch that is partly marked is cut to its longest free part."""
    heap = [(-n, i, j) for i, j, n in matches if n >= least]
    heapq.heapify(heap)
    used_a, used_b, out = set(), set(), []
    while heap:
        n, i, j = heapq.heappop(heap)
        free, best = 0, (0, 0)
        for k in range(-n):
            free = 0 if (i + k) in used_a or (j + k) in used_b else free + 1
            best = max(best, (free, -k))
        if best[0] == -n:
            out.append((i, j, -n))
            used_a.update(range(i, i - n))
            used_b.update(range(j, j - n))
        elif best[0] >= least:
            begin = -best[1] - best[0] + 1
            heapq.heappush(heap, (-best[0], i + begin, j + begin))
            # what lies beside the longest free part can still be long enough
            for a, b in ((0, begin), (begin + best[0], -n)):
                if b - a >= least:
                    heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def stretches(at: np.ndarray, place: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal common stretches from the seeds of one pair: seeds that follow each other on a diagonal join."""
    order = np.lexsort((at, at - place))
    a, b = at[order], place[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1)]))
    n = np.diff(np.append(new, len(a)))
    return [(int(a[k]), int(b[k]), int(c) + length - 1) for k, c in zip(new, n)]


def leaks(corpus: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WORDS, tile: int = WORDS, coverage: float = 1.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(``id_col``, ``item_col``, n_tiles, longest_tile, matched_words, item_words, coverage) of every pair that leaks.

    Words are the longest runs of letters or digits of the lower-cased text. A tile has at least ``tile`` words, or all
    words of a shorter item. A pair leaks if a tile has at least ``n`` words (or the whole item), or if its tiles together cover at least the share
    ``coverage`` of the item, as they do where a passage was cut into pieces and reordered. Texts that are null or without words, on either side, match nothing. Rows are compared as
    they come: a repeated document or item gives a row each time. Other columns aren't read. Hash matches are confirmed
    word by word. A null item id is left out.
    """
    spark = corpus.sparkSession
    kinds = corpus.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    blocks, block, words = [], [], 0
    for r in items.where(F.col(item_col).isNotNull()).select(item_col, item_text_col).toLocalIterator():
        block.append((r[0], r[1]))
        words += len(r[1] or "") // 2 + 1
        if words >= block_words:
            blocks.append(block)
            block, words = [], 0
    blocks.append(block)
    docs = corpus.selectExpr(f"`{id_col}` AS __id", f"`{text_col}` AS __text").where("__text IS NOT NULL")
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(Seeds(block, min(tile, n))) if block else None

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, rows = [], []
                if shared is not None:
                    for first, part in chunks(b.column(1).to_pylist()):
                        for text, row in _pairs(Words(part), shared.value):
                            ids.append(first + text)
                            rows.append(row)
                values = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate([item_type, *[pa.int32()] * 4])]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), *values], ["__id", "__item", "n_tiles", "longest_tile", "matched_words", "item_words"])

        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(items.schema[item_col].dataType)
        part = docs.mapInArrow(run, f"__id {kinds[0]}, __item {kinds[1]}, n_tiles int, longest_tile int, matched_words int, item_words int")
        out = part if out is None else out.unionByName(part)
    whole = F.col("longest_tile") >= F.least(F.lit(n), F.col("item_words"))
    return out.where(whole | (F.col("matched_words") >= coverage * F.col("item_words"))).select(
        F.col("__id").alias(id_col), F.col("__item").alias(item_col), "n_tiles", "longest_tile", "matched_words", "item_words",
        (F.col("matched_words") / F.col("item_words")).alias("coverage"),
    )


def _pairs(w: Words, seeds: Seeds) -> Iterator[tuple[int, tuple]]:
    for length, text, item, at, place in seeds.matches(w):
        order = np.lexsort((item, text))
        text, item, at, place = text[order], item[order], at[order], place[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(item) != 0)])) if len(text) else []
        for a, b in zip(new, np.append(new[1:], len(text))):
            t, i = int(text[a]), int(item[a])
            found = []
            for x, y, size in tiles(stretches(at[a:b], place[a:b], length), length):
                if w.strings(w.first[t] + x, w.first[t] + x + size) == seeds.words[i][y : y + size]:
                    found.append(size)
            if found:
                yield t, (seeds.ids[i], len(found), max(found), sum(found), len(seeds.words[i]))
