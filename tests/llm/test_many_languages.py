from spatialrank.llm import langid


def test_rare_languages_are_learned(spark):
    words = {"en": "the cat and the dog", "de": "der hund und die katze", "fi": "kissa ja koira talossa"}
    rows = [(i, f"{words[k]} {i}", k) for i, k in enumerate(["en"] * 40 + ["de"] * 30 + ["fi"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, most_each=20, most_languages=2)
    assert sorted(model.languages) == ["de", "en", "fi"]
    got = {r.doc_id: r.lang_pred for r in model.score(docs).collect()}
    assert all(got[i] == k for i, _, k in rows)


def test_sample_sizes():
    assert langid.sample_sizes(4, 800, 100)[0] == langid.sample_sizes(100, 800, 100)[0] == 800
    for n in (101, 192, 1000, 3000):
        assert 0 < n * langid.sample_sizes(n, 800, 100)[0] * max(n, langid.LANDMARKS) <= 800 * 100 * langid.LANDMARKS
