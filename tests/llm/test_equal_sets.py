"""Problem 4: texts that differ but have the same set of shingles."""

from lorekeep.llm.neardup import similar_pairs


def test_different_texts_of_one_set_come_out_as_all_pairs(spark):
    words = "one two three four five six seven eight nine ten eleven".split()
    rows = [(f"c{n:03d}", " ".join(w.upper() if n >> k & 1 else w for k, w in enumerate(words))) for n in range(120)]
    got = [tuple(r) for r in similar_pairs(spark.createDataFrame(rows, "id string, summary string"), "id", ["summary"]).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, _ in rows for b, _ in rows if a < b}
