"""Names and capitals at the start of sentences and lines; items without template windows."""

from ledgergraph.llm import templates


def found(spark, docs, items):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = templates.leaked_items(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_first_words_are_read_both_ways(spark):
    items = ["Tom has 3 apples and buys 4 more.", "What is the capital of France?",
             "Anna walks her dog to the park today. Paul rides a red bike to the school. Mary reads an old book in the garden."]
    docs = ["Sara has 5 apples and buys 2 more.", "Exercise 4\nWhat is the capital of France?", "so what is the capital of Spain",
            items[2].replace("Anna", "Olga").replace("Paul", "Hugo").replace("Mary", "Nina"), "We know that Sara has 5 apples and buys 2 more.",
            "Exercise 5\r\nSara has 5 apples and buys 2 more.", "He has many apples and buys 2 more."]
    got = found(spark, docs, items)
    assert set(got) == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 0), (5, 0)}
    assert got[1, 1].verbatim and got[3, 2].share == 1 and not got[0, 0].verbatim and got[0, 0].agreement == 1


def test_a_unit_may_follow_on_the_next_line(spark):
    assert set(found(spark, ["they carried a box of 12\nkg over the long bridge"], ["they carried a box of 5 kg over the long bridge"])) == {(0, 0)}


def test_every_reading_of_a_window_is_hashed():
    import pyarrow as pa
    t = templates.tokens_of(pa.array(["One. Yes. No. so it is then now"]))
    at, hashes, reading = templates.windows_of(t, 8)
    assert len(set(hashes.tolist())) == len(at) == 4 and sorted(reading.tolist()) == [0, 2, 4, 6]


def test_items_without_template_windows_are_found_verbatim(spark):
    items = ["What is 17 times 24?", "Compute 12 + 7 * 3 - 4", "Anna Bob", "1 2 3 4 5 6 7 8 9 10 11 12", "...", "the sum of 2 and many old things"]
    docs = [f"some words before it. {x} and some words after it" for x in items]
    docs += ["what is 18 times 24?", "Compute 12 + 7 * 3 - 5", "Anna and Bob", "1 2 3 4 5 6 7 9 8 10 11 12"]
    got = found(spark, docs, items)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 5)} and all(r.verbatim for r in got.values())
