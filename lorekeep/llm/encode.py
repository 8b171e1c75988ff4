"""Problem 6: exact byte-pair ids of every text.

Each piece of a text (the pattern of the public vocabularies) is encoded by backtracking: Aho-Corasick gives the longest
token that starts at each byte, and a token may follow another only if the merges would keep that pair apart
(pair-compatibility table). A piece that can't go on takes the next shorter token, or goes back one token; no byte
position is tried twice, so the time is linear. Pieces repeat, so each worker remembers theirs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.text_runs import LETTER, NUMBER, SPACE, Runs, chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces longer than this aren't looked up by hash; at most so many pieces are remembered by a worker.
LONG_PIECE, REMEMBERED = 256, 1_000_000


class PieceEncoder:
    """Encodes pieces of bytes with the vocabulary in the rank file ``path``."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ids = {base64.b64decode(t): int(i) for t, i in pairs}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.longest = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.longest.add_word(t.decode("latin-1"), i)
        self.longest.make_automaton()
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self.parts:
            text = self.tokens[token]
            now = [self.ids[text[i : i + 1]] for i in range(len(text))]
            while len(now) > 2:
                ranked = [(self.ids.get(self.tokens[a] + self.tokens[b], token), i) for i, (a, b) in enumerate(zip(now, now[1:]))]
                rank, i = min(ranked)
                if rank >= token:
                    raise ValueError(f"token {token} can't be reached by merges")
                now[i : i + 2] = [rank]
            self.parts[token] = tuple(now) if len(now) == 2 else None
        return self.parts[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` as neighbours: going back in time, the edge tokens are taken apart youngest first; a merge over the border that ranks before the younger was made would have come first."""
        key = (left, right)
        known = self.apart.get(key)
        if known is None:
            made = 1 << 62
            known = True
            while True:
                over = self.ids.get(self.tokens[left] + self.tokens[right])
                if over is not None and over < made:
                    known = False
                    break
                a, b = self.halves(left), self.halves(right)
                if a is None and b is None:
                    break
                # of equal age, the left occurrence was merged first, so the right one is taken apart first
                if b is None or (a is not None and left > right):
                    made, left = left, a[1]
                else:
                    made, right = right + 1, b[0]
            self.apart[key] = known
        return known

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        found = self.shorter.get(token)
        if found is None:
            text = self.tokens[token]
            found = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
            self.shorter[token] = found
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        first = [-1] * (n + 1)
        size = [0] * n
        for end, token in self.longest.iter(piece.decode("latin-1")):
            length = len(self.tokens[token])
            at = end - length + 1
            if length > size[at]:
                size[at], first[at] = length, token
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, first[0]
        while at < n:
            while token >= 0:
                end = at + len(self.tokens[token])
                if open_at[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at, token = end, first[end]
            elif not out:
                raise ValueError("the vocabulary lacks single bytes")
            else:
                open_at[at] = 0
                last = out.pop()
                at -= len(self.tokens[last])
                token = self.next_shorter(last)
        return out


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


#: Kinds of characters by their class bits: 0 none, 1 letters, 2 numbers, 3 white space, 4 others.
_KINDS = np.array([3 if b & SPACE else 1 if b & LETTER else 2 if b & NUMBER else 4 for b in range(16)], np.int8)


def pieces(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that the vocabularies' pattern finds, for all texts of ``runs``."""
    p = runs.points
    kind = _KINDS[runs.bits]
    kind[runs.ends] = 0
    begin = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    kinds = kind[begin]
    end = np.append(begin[1:], len(kind))
    following = np.append(kinds[1:], 0)
    space = kinds == 3
    # White space before something else gives its last character away: to the next piece if it is a space, else as a piece of its own.
    gives = space & (following > 0)
    to_next = gives & (p[end - 1] == 0x20)
    after_space = np.append(False, to_next[:-1])
    cut = np.zeros(len(p), bool)
    cut[begin] = True
    cut[begin[after_space]] = False
    cut[end[gives] - 1] = True
    # 's 't 'm 'd and 're 've 'll: an apostrophe alone that no space precedes, before letters (fixed values)
    quote = np.flatnonzero((kinds == 4) & (end - begin == 1) & (following == 1) & ~after_space)
    quote = quote[p[begin[quote]] == 0x27]
    at, after = begin[quote], end[quote + 1]
    a, b = p[at + 1], p[np.minimum(at + 2, len(p) - 1)]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ~one & (after - at > 2) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
    cut[at[one | two] + 1] = False
    rest = np.concatenate([at[one] + 2, at[two] + 3])
    cut[rest] = True  # where the letters end there, something else begins anyway
    bounds = np.flatnonzero(cut)
    inside = kind[bounds] > 0
    return bounds[inside], np.append(bounds[1:], len(p))[inside]


class Memory:
    """Ids of the pieces met so far, by their hash."""

    def __init__(self, path: str):
        self.encode = encoder(path).encode
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ids_of(self, runs: Runs, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids)."""
        if len(self.known) > REMEMBERED:
            self.clear()
        lengths = ends - starts
        hashes = runs.hashes(starts, ends)
        long = np.flatnonzero(lengths > LONG_PIECE)
        hashes[long] = np.arange(len(long), dtype=np.uint64)  # each on its own; forgotten below
        place, distinct = pd.factorize(hashes)
        sample = np.empty(len(distinct), np.int64)
        sample[place[::-1]] = np.arange(len(place) - 1, -1, -1)
        own = set(sample[lengths[sample] > LONG_PIECE].tolist())
        at = [-1 if i in own else self.known.get(h, -1) for h, i in zip(distinct.tolist(), sample.tolist())]
        fresh = []
        held = len(self.offsets) - 1
        for k, index in enumerate(at):
            if index < 0:
                i = int(sample[k])
                fresh.append(self.encode(runs.text[starts[i] : ends[i]].encode("utf-8", "surrogatepass")))
                at[k] = held
                if i not in own:
                    self.known[int(distinct[k])] = held
                held += 1
        if fresh:
            self.flat = np.concatenate([self.flat, *[np.array(x, np.int32) for x in fresh]])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum([len(x) for x in fresh])])
        index = np.array(at, np.int64)[place]
        first = self.offsets[index]
        n = self.offsets[index + 1] - first
        return n, self.flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def encode_texts(texts: list[str | None], path: str, memory: Memory | None = None) -> pa.ListArray:
    """The ids of each text; no ids for empty and null texts."""
    memory = memory or Memory(path)
    counts, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for _, part in chunks(texts):
        runs = Runs(part)
        starts, ends = pieces(runs)
        n, ids = memory.ids_of(runs, starts, ends)
        upto = np.append(0, np.cumsum(n))
        counts.append(np.diff(upto[np.searchsorted(starts, runs.ends)], prepend=0))
        values.append(ids)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(values))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(``id_col``, ``ids``) of every row: the ids of its text without special tokens.

    An empty or null text has the empty list of ids. Special tokens' strings are ordinary text. Rows are encoded one by
    one, so repeated rows and ids come out as often as they came in; other columns aren't read. ``path`` must be there
    on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), encode_texts(b.column(1).to_pylist(), path, memory)], ["__id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.selectExpr(f"`{id_col}` AS __id", f"`{text_col}` AS __text").mapInArrow(run, f"__id {kind}, ids array<int>").withColumnRenamed("__id", id_col)


class Decoder:
    """Bytes of ids, from one string of all tokens and a table of offsets."""

    def __init__(self, path: str):
        tokens = encoder(path).tokens
        parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        n = self.offsets[ids + 1] - self.offsets[ids]
        to = np.cumsum(n) - n
        return self.bytes[np.repeat(self.offsets[ids] - to, n) + np.arange(n.sum())].tobytes()


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(``id_col``, ``text``): the inverse of :func:`encode`; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Decoder(path)
        for b in batches:
            texts = [table.decode(x).decode("utf-8", "replace") for x in (v or [] for v in b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["__id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.selectExpr(f"`{id_col}` AS __id", f"`{ids_col}` AS __ids").mapInArrow(run, f"__id {kind}, text string").withColumnRenamed("__id", id_col)


def token_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400, step: int = 320, path: str = VOCABULARY) -> DataFrame:
    """(``id_col``, ``piece``, ``n_tokens``, ``start_line``, ``end_line``, ``hash``, ``text``): pieces of ``size`` tokens of each text, a new one every ``step`` until one reaches the end.

    Pieces count from 0, lines from 1; ``hash`` is the piece's SHA-256. A token that is part of a character comes out as U+FFFD at a piece's edge. Null and
    empty texts have no piece; repeated rows come out as often as they came in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Decoder(path)
        breaks = np.append(0, np.cumsum(table.bytes == 0x0A))
        n_breaks = breaks[table.offsets[1:]] - breaks[table.offsets[:-1]]
        for b in batches:
            rows: list[tuple] = []
            for k, ids in enumerate(b.column(1).to_pylist()):
                ids = np.array(ids, np.int64)
                lines = 1 + np.append(0, np.cumsum(n_breaks[ids]))
                for piece in range(max(0, -(-(len(ids) - size) // step)) + 1 if len(ids) else 0):
                    own = ids[piece * step : piece * step + size]
                    text = table.decode(own).decode("utf-8", "replace")
                    begin = piece * step
                    rows.append((k, piece, len(own), int(lines[begin]), int(lines[begin + len(own)]), hashlib.sha256(text.encode()).hexdigest(), text))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int32()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], kinds)]], ["__id", "piece", "n_tokens", "start_line", "end_line", "hash", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    ids = encode(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__id", "__text", path)
    return ids.mapInArrow(run, f"__id {kind}, piece int, n_tokens int, start_line int, end_line int, hash string, text string").withColumnRenamed("__id", id_col)
