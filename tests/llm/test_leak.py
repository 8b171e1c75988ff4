import pytest

from lorekeep.llm.leak import leaks, tiles

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
REORDERED = "a b c d e f g h i j k l m n o p q r s t u v w x y z"


@pytest.fixture(scope="module")
def tables(spark):
    first, last = " ".join(REORDERED.split()[:12]), " ".join(REORDERED.split()[12:])
    docs = [
        (1, "Before: " + ITEM.upper().replace(" ", ", ") + ". After"), (2, " ".join(ITEM.split()[:11])), (3, None), (4, ""), (5, "x short item here y"), (6, "SHORT, item: here"), (7, "short item"), (8, f"{last} -- {first}"),
        (9, " ".join(ITEM.split()[1:13])), (9, " ".join(ITEM.split()[1:13])), (10, "filler words again " * 50_000 + ITEM), (11, ITEM + " pause " + ITEM), (None, ITEM),
    ]
    items = [(1, ITEM), (2, "short item here"), (3, None), (4, " .. "), (5, REORDERED), (6, ITEM), (None, ITEM)]
    return spark.createDataFrame([(i, t, 3, "t") for i, t in docs], "doc_id long, text string, n_tiles int, item_id string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_words", [5, 1_000_000])
def test_pairs(tables, block_words):
    docs, items = tables
    got = leaks(docs, items, block_words=block_words).collect()
    pairs = sorted((r["doc_id"] or 0, r["item_id"]) for r in got)
    assert pairs == [(0, 1), (0, 6), (1, 1), (1, 6), (5, 2), (6, 2), (8, 5), (9, 1), (9, 1), (9, 6), (9, 6), (10, 1), (10, 6), (11, 1), (11, 6)]
    by = {(r["doc_id"], r["item_id"]): r for r in got}
    assert by[(8, 5)]["n_tiles"] == 2 and by[(8, 5)]["coverage"] == 1.0
    assert by[(9, 1)]["longest_tile"] == 12 and by[(9, 1)]["coverage"] == pytest.approx(12 / 14)
    assert by[(11, 1)]["n_tiles"] == 1 and by[(11, 1)]["matched_words"] == 14


def test_empty_sides(tables):
    docs, items = tables
    assert leaks(docs.where("false"), items).count() == 0 and leaks(docs, items.where("false")).count() == 0


def test_tiles_take_the_longest_first_and_never_overlap():
    assert tiles([(0, 0, 20), (15, 100, 10)], 3) == [(0, 0, 20), (20, 105, 5)]
    assert tiles([(0, 0, 5), (0, 10, 5)], 3) == [(0, 0, 5)]
    assert tiles([(0, 0, 2)], 3) == []


def test_a_passage_in_short_pieces_leaks_by_coverage(spark):
    words = REORDERED.split()
    pieces = [" ".join(words[k : k + 6]) for k in (18, 0, 12, 6)]
    docs = spark.createDataFrame([(1, " -- ".join(f"{p} and so on" for p in pieces)), (2, pieces[0] + " alone"), (3, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([(5, REORDERED)], "item_id long, text string")
    assert [r["doc_id"] for r in leaks(docs, items).collect()] == [3]
    got = {r["doc_id"]: r for r in leaks(docs, items, tile=6, coverage=0.5).collect()}
    assert set(got) == {1, 3} and got[1]["n_tiles"] == 4 and got[1]["longest_tile"] == 6 and got[1]["coverage"] == pytest.approx(24 / 26)


def test_texts_of_one_word(spark):
    docs = spark.createDataFrame([(1, "again " * 60_000), (2, "x " + "again " * 15 + "y"), (3, "again " * 5)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "again " * 1000), (6, "x " + "again " * 20 + "y"), (7, "z " + "again " * 13)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["longest_tile"] for r in leaks(docs, items, tile=6).collect()}
    assert got == {(1, 5): 1000, (1, 6): 20, (1, 7): 13, (2, 5): 15, (2, 6): 16, (2, 7): 13}


def test_a_word_that_ends_one_text_and_begins_the_next(spark):
    docs = spark.createDataFrame([(k, "word") for k in range(5)], "doc_id long, text string").coalesce(1)
    assert leaks(docs, spark.createDataFrame([(1, "Word")], "item_id long, text string")).count() == 5
