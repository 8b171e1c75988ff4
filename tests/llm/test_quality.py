import numpy as np
import pytest
from conftest import SMALL

from lorekeep.llm.quality import CORE, LEAST_TEXTS, STATISTICS, quality

PROSE = "The quiet cat rested on the carpet and it was the end of a summer day. Then the sleepy dog came to the house and all was well with it."


@pytest.fixture(scope="module")
def result(spark):
    docs = [(n, PROSE + f" And so it was in the year {n}.", "en") for n in range(80)]
    docs += [(100, None, "en"), (101, "", "en"), (102, " \n\t", None), (103, "== || == ##\n-- ** --", "de"), (104, "ab cd.\nEF gh!\n\n  ij kl …  ", None), (105, " ", "en"), (106, "x" * 200_000, "en"), (0, PROSE + " And so it was in the year 0.", "en")]
    words = spark.createDataFrame([("en", w) for w in "the a and it was of on to in all with".split()] + [("de", "und"), (None, "x"), ("de", None)], "lang string, word string")
    df = spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id long, text string, lang string, n_words int, outlierness double")
    return df, words, [r.asDict() for r in quality(df, words).collect()]


def test_rows(result):
    ids = [r["doc_id"] for r in result[2]]
    assert sorted(ids) == sorted([0, *range(80), 103, 104, 105, 106])


def test_counts(result):
    r = next(r for r in result[2] if r["doc_id"] == 104)
    assert (r["n_words"], r["n_chars"], r["n_symbols"], r["n_lines"], r["n_punctuated"], r["n_common"]) == (7, 15, 3, 3, 3, 0)
    r = next(r for r in result[2] if r["doc_id"] == 103)
    assert r["n_signs"] == 4 and r["many_symbols"] and r["few_punctuated_lines"] and r["few_common_words"] and r["odd_word_length"]
    assert next(r for r in result[2] if r["doc_id"] == 7)["n_signs"] == 0
    assert next(r for r in result[2] if r["doc_id"] == 105)["n_words"] == 1


def test_contributions_add_up_and_junk_lies_far_out(result):
    for r in result[2]:
        assert sum(r[f"contribution_{c}"] for c in STATISTICS) == pytest.approx(r["outlierness"], rel=1e-6, abs=1e-6)
    prose = max(r["outlierness"] for r in result[2] if r["doc_id"] < 80)
    assert all(r["outlierness"] > 10 * prose for r in result[2] if r["doc_id"] in (103, 106))


def test_empty(result):
    df, words, _ = result
    assert quality(df.where("false"), words).count() == 0
    few = quality(df.where("doc_id = 104"), words.where("false")).collect()
    assert len(few) == 1 and few[0]["outlierness"] is None and few[0]["language"] == "und"


def test_distance_against_numpy(spark):
    """The distance and its parts from the statistics alone, by numpy, on the smallest tables."""
    got = quality(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/common_words.parquet")).toPandas()
    x = got[STATISTICS].to_numpy(float)
    model = np.where(got["language"].map(got["language"].value_counts()).to_numpy() >= LEAST_TEXTS, got["language"], "*")
    fits = {}
    for name in ["*", *set(got["language"])]:
        rows = x if name == "*" else x[(got["language"] == name).to_numpy()]
        if len(rows) < LEAST_TEXTS:
            continue
        middle = np.sort(rows, axis=0)[(len(rows) - 1) // 2]
        spread = np.sort(np.abs(rows - middle), axis=0)[(len(rows) - 1) // 2]
        core = rows[(np.abs(rows - middle) <= CORE * np.maximum(1.4826 * spread, 1e-3)).all(1)]
        if len(core) < LEAST_TEXTS:
            continue
        cov = np.cov(core.T, bias=True)
        scale = np.maximum(np.sqrt(np.diag(cov)), 1e-3)
        fits[name] = core.mean(0), np.linalg.inv(cov / np.outer(scale, scale) + 0.01 * np.eye(x.shape[1])) / np.outer(scale, scale)
    for k, name in enumerate(model):
        mean, inverse = fits.get(name, fits.get("*", (None, None)))
        if mean is None:
            assert np.isnan(got["outlierness"][k])
            continue
        parts = (x[k] - mean) * (inverse @ (x[k] - mean))
        assert got[[f"contribution_{c}" for c in STATISTICS]].to_numpy(float)[k] == pytest.approx(parts, rel=1e-5, abs=1e-5)
