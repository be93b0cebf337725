from spatialrank.llm import decontaminate as d


def test_short_items_keep_their_edits(spark):
    item = "which river flows by the castle"
    docs = spark.createDataFrame([(1, f"so {item} then"), (2, f"so {item.replace('river', 'rivir').replace('castle', 'cestle')} then"), (3, f"so {item.replace('river', 'rivir')} then"), (4, "no river at all")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(r.doc_id, r.edits) for r in d.leaks(docs, bench).collect()} == {(1, 0), (2, 2), (3, 1)}


def test_the_bound_stays_positive():
    assert all(m - d.Q + 1 - d.Q * d.edits(m) >= 1 for m in range(d.Q, 2000))
    assert [d.edits(m) for m in (8, 15, 16, 30, 47, 48, 95)] == [0, 0, 1, 2, 3, 4, 7]


def test_items_without_a_qgram_match_exactly(spark):
    docs = spark.createDataFrame([(1, "the code ABC123 is here"), (2, "abc 123"), (3, "xabc1234"), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "abc123"), (8, "Abc123"), (9, "c1"), (10, " "), (11, "seven77")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in d.leaks(docs, bench).collect()} == {(k, i, 0) for k in (1, 3) for i in (7, 8, 9)}
