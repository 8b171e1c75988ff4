"""Problem 8: quality statistics of each text, and how far they lie from prose of its language.

Statistics are counted for a batch of texts at once. For each language, the centre and the spread of every statistic are
first taken robustly (median, and median absolute deviation as a scale), then mean and covariance over the texts that lie
within ``CORE`` scales in all statistics; the squared Mahalanobis distance to that prose is the text's outlierness, and
it is the sum of one contribution for each statistic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.text_runs import BLANK, LETTER, NUMBER, Runs, chunks
from lorekeep.operators.skew import if_small
from lorekeep.session import written

#: What the distance is taken over.
STATISTICS = ["log_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "digit_ratio", "words_per_line"]
COUNTS = ["n_words", "n_chars", "n_symbols", "n_digits", "n_lines", "n_punctuated", "n_common"]
ENDS = ".!?…"
#: Most rows of the word list that tasks get; it is refused beyond that.
LIST_ROWS = 1_000_000
CORE = 3.0
#: Accuracy of the medians: they are off by one in as many of the rows at most.
ACCURACY = 10_000
#: A language with fewer texts is held against the texts of all languages.
LEAST_TEXTS = 50


class CommonWords:
    """Hashes of the listed words, and for each the languages that list it as a bit set."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in rows})
        by_word: dict[str, int] = {}
        for lang, word in rows:
            by_word[word] = by_word.get(word, 0) | 1 << self.languages.index(lang)
        words = sorted(by_word)
        runs = Runs(words) if words else None
        hashes = runs.hashes(runs.starts, runs.ends) if words else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.bits = hashes[order], np.array([by_word[w] for w in words], np.int64)[order]

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The languages' bits of each hash; 0 if it is no listed word."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.bits[at], 0)


def _per_text(runs: Runs, positions: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(positions, runs.ends), prepend=0)


def count(texts: list[str], common: CommonWords) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """COUNTS of each text, and the number of its words that each language lists."""
    runs = Runs(texts)
    real = np.ones(len(runs.points), bool)
    real[runs.ends] = False
    blank = (runs.bits & BLANK) > 0
    solid = real & ~blank
    starts, ends = runs.spans(solid)
    out = {"n_words": _per_text(runs, starts)}
    out["n_chars"] = _per_text(runs, np.flatnonzero(solid))
    out["n_symbols"] = _per_text(runs, np.flatnonzero(solid & ((runs.bits & (LETTER | NUMBER)) == 0)))
    out["n_digits"] = _per_text(runs, np.flatnonzero((runs.bits & NUMBER) > 0))
    # lines that aren't blank, by their last word's last character
    breaks = np.flatnonzero((runs.points == 0x0A) | ~real)
    line = np.searchsorted(breaks, starts)
    last = np.flatnonzero(np.append(np.diff(line) != 0, True)) if len(line) else np.zeros(0, np.int64)
    out["n_lines"] = _per_text(runs, starts[last])
    out["n_punctuated"] = _per_text(runs, starts[last[np.isin(runs.points[ends[last] - 1], [ord(c) for c in ENDS])]])
    # words of the lower-cased text, without what is no letter at both ends
    low = Runs([t.lower() for t in texts])
    real = np.ones(len(low.points), bool)
    real[low.ends] = False
    starts, ends = low.spans(real & ((low.bits & BLANK) == 0))
    letters = np.append(np.flatnonzero(low.bits & LETTER), len(low.points))
    first = letters[np.searchsorted(letters, starts)]
    inside = first < ends
    final = letters[np.searchsorted(letters, ends[inside]) - 1] + 1
    bits = common.look_up(low.hashes(first[inside], final))
    at = starts[inside]
    out["n_common"] = _per_text(low, at[bits > 0])
    by_language = [_per_text(low, at[(bits >> k) & 1 > 0]) for k in range(len(common.languages))]
    return out, np.array(by_language).reshape(len(common.languages), len(texts))


def counts(df: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """COUNTS of every text that has a word, and ``language``: the one that lists most of its words, at least a tenth of them; else the declared one, lower-cased; else "und"."""
    rows = common_words.where("lang IS NOT NULL AND word IS NOT NULL").select("lang", "word").distinct().limit(LIST_ROWS + 1).collect()
    if len(rows) > LIST_ROWS:
        raise ValueError(f"the list of common words has more than {LIST_ROWS} rows")
    common = CommonWords([(r[0], r[1]) for r in rows])
    shared = df.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        names = np.array([*words.languages, None], object)
        for b in batches:
            parts = [count(part, words) for _, part in chunks(b.column(1).to_pylist())]
            if not parts:
                continue
            cols = {c: np.concatenate([p[0][c] for p in parts]).astype(np.int64) for c in COUNTS}
            by_language = np.concatenate([p[1] for p in parts], axis=1)
            if len(words.languages):
                best = np.where(by_language.max(0) * 10 >= np.maximum(cols["n_words"], 1), by_language.argmax(0), -1)
            else:
                best = np.full(len(b), -1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(names[best], pa.string()), *[pa.array(cols[c]) for c in COUNTS]], ["__id", "__lang", "__found", *COUNTS])

    kind = df.schema[id_col].dataType.simpleString()
    lang = f"`{lang_col}`" if lang_col else "CAST(NULL AS STRING)"
    out = df.selectExpr(f"`{id_col}` AS __id", f"`{text_col}` AS __text", f"{lang} AS __lang").where("__text IS NOT NULL")
    out = out.mapInArrow(run, f"__id {kind}, __lang string, __found string, {', '.join(c + ' bigint' for c in COUNTS)}").where("n_words > 0")
    language = F.coalesce("__found", F.nullif(F.lower(F.trim("__lang")), F.lit("")), F.lit("und"))
    return out.select(F.col("__id").alias(id_col), language.alias("language"), *COUNTS)


def statistics(c: DataFrame) -> DataFrame:
    """STATISTICS from COUNTS."""
    words = F.col("n_words")
    return c.withColumns({
        "log_words": F.log1p(words.cast("double")),
        "mean_word_length": F.col("n_chars") / words,
        "symbol_ratio": F.col("n_symbols") / F.col("n_chars"),
        "punctuated_lines": F.col("n_punctuated") / F.col("n_lines"),
        "common_words": F.col("n_common") / words,
        "digit_ratio": F.col("n_digits") / F.col("n_chars"),
        "words_per_line": words / F.col("n_lines"),
    })


def flags() -> dict[str, Column]:
    """The four signs of junk; they are compared by counts, so that no rounding decides."""
    return {
        "many_symbols": F.col("n_symbols") * 100 > F.col("n_chars") * 15,
        "few_punctuated_lines": F.col("n_punctuated") * 10 < F.col("n_lines") * 4,
        "few_common_words": F.col("n_common") * 10 < F.col("n_words") * 2,
        "odd_word_length": (F.col("n_chars") < F.col("n_words") * 3) | (F.col("n_chars") > F.col("n_words") * 9),
    }


def _core_sums(rows: DataFrame) -> list:
    """Counts, sums and sums of products of each language's core, around its medians."""
    middle = rows.groupBy("language").agg(*[F.percentile_approx(c, 0.5, ACCURACY).alias(f"m_{c}") for c in STATISTICS])
    spread = rows.join(if_small(middle), "language").groupBy("language").agg(
        *[F.first(f"m_{c}").alias(f"m_{c}") for c in STATISTICS],
        *[F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{c}")), 0.5, ACCURACY).alias(f"s_{c}") for c in STATISTICS],
    )
    core = rows.join(if_small(spread), "language")
    for c in STATISTICS:
        core = core.where(F.abs(F.col(c) - F.col(f"m_{c}")) <= CORE * F.greatest(1.4826 * F.col(f"s_{c}"), F.lit(1e-3)))
    shifted = [F.col(c) - F.col(f"m_{c}") for c in STATISTICS]
    d = len(STATISTICS)
    sums = core.groupBy("language").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.first(f"m_{c}").alias(f"m{i}") for i, c in enumerate(STATISTICS)],
        *[F.sum(x).alias(f"x{i}") for i, x in enumerate(shifted)],
        *[F.sum(shifted[i] * shifted[j]).alias(f"x{i}_{j}") for i in range(d) for j in range(i, d)],
    )
    return sums.where(F.col("n") >= LEAST_TEXTS).collect()


def _fit(s: DataFrame) -> list[tuple]:
    """(language, mean, inverse covariance) for each language with LEAST_TEXTS texts in the core, and for all ("*")."""
    # a language is one with LEAST_TEXTS texts, so declared languages that only dirt names never reach a broadcast; "*" stands for all texts
    enough = s.groupBy("language").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS).select("language")
    own = s.join(if_small(enough), "language", "left_semi").select("language", *STATISTICS)
    rows = _core_sums(own) + _core_sums(s.select(F.lit("*").alias("language"), *STATISTICS))
    d = len(STATISTICS)
    out = []
    for r in rows:  # one row for each language
        mean = np.array([r[f"x{i}"] for i in range(d)]) / r["n"]
        cov = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / r["n"] - np.outer(mean, mean)
        scale = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), 1e-3)
        ridge = cov / np.outer(scale, scale) + 0.01 * np.eye(d)
        inverse = np.linalg.inv(ridge) / np.outer(scale, scale)
        out.append((r["language"], (mean + [r[f"m{i}"] for i in range(d)]).tolist(), inverse.ravel().tolist()))
    return out


def quality(df: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """For every row whose text has a word: COUNTS, STATISTICS, the four signs, ``n_signs``, ``outlierness`` and ``contribution_*``.

    Words are the pieces between blanks (space, tab, CR, LF). Null, empty and blank texts give no row; repeated rows come
    out as often as they came in; other columns aren't read. Where no language, nor all texts together, have LEAST_TEXTS
    texts of prose, outlierness and contributions are null.
    """
    s = statistics(written(counts(df, common_words, id_col, text_col, lang_col)))
    fit = _fit(s)
    known = [f[0] for f in fit]
    model = df.sparkSession.createDataFrame(fit or [("*", None, None)], "__model string, __mean array<double>, __inverse array<double>")
    s = s.withColumn("__model", F.when(F.col("language").isin(known), F.col("language")).otherwise("*") if known else F.lit("*"))
    s = s.join(F.broadcast(model), "__model", "left")
    d = len(STATISTICS)
    apart = [F.col(c) - F.col("__mean")[i] for i, c in enumerate(STATISTICS)]
    parts = {}
    for i, c in enumerate(STATISTICS):
        weighted = None
        for j in range(d):
            term = F.col("__inverse")[i * d + j] * apart[j]
            weighted = term if weighted is None else weighted + term
        parts[f"contribution_{c}"] = apart[i] * weighted
    signs = flags()
    total = None
    for c in parts:
        total = F.col(c) if total is None else total + F.col(c)
    n_signs = None
    for c in signs:
        one = F.col(c).cast("int")
        n_signs = one if n_signs is None else n_signs + one
    return s.withColumns(parts | signs).withColumns({"outlierness": total, "n_signs": n_signs}).drop("__model", "__mean", "__inverse")
