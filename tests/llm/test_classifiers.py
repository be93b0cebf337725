import zlib

import numpy as np
import pyarrow as pa
import pytest

from spatialrank.llm import langid, learning, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(None, "null id"), (1, None), (2, ""), (2, ""), (3, " \n\t"), (4, "x" * 200_000), (5, "12 34 !!"), (6, "word " * 20_000)]


def odd_docs(spark):
    return spark.createDataFrame([(k, t, None, "s", 0.5) for k, t in ODD], "doc_id long, text string, lang string, features string, score double")


def held(doc_id, by, rest):
    return zlib.crc32(str(doc_id).encode()) % by == rest


@pytest.mark.parametrize("query, by, rest, label, least", [("op4_nonnegative_pu_toxicity", 5, 0, "toxic", 0.9), ("op8_attention_quality", 4, 2, "quality", 0.95)])
def test_held_out_accuracy(spark, query, by, rest, label, least):
    got = queries.queries()[query](spark, SF).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [held(i, by, rest) for i in got.doc_id]).all()
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both[label]).mean() >= least


def test_languages_held_out(spark):
    got = queries.op7_string_kernel_language(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == 1000 and (got.lang_pred == got.lang)[got.held_out].mean() >= 0.97


def test_odd_texts(spark):
    docs, labels = odd_docs(spark), spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 1, 0), (6, None, None), (None, 1, 1), (99, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for model in (toxicity.train(docs, labels), quality.train(docs, labels), toxicity.train(docs, labels.limit(0)), quality.train(docs, labels.limit(0)), quality.train(docs.limit(0), labels)):
        rows = model.score(docs).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert model.score(docs.limit(0)).count() == 0
    none = langid.train(docs)
    assert {r.lang_pred for r in none.score(docs).collect()} == {"und"}
    known = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.train(known).score(docs).collect()}
    assert got[1] == got[2] == got[3] == got[5] == "und" and got[4] in ("en", "de")


def test_kernel_is_presence_kernel():
    texts = ["abca", "bcd é", "", "ABCA 12"]
    seen = langid.presence(pa.array(texts))
    for i, t in enumerate(texts):
        raw = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in t.lower().encode())
        assert seen[i].sum() == len({raw[k : k + n] for n in (1, 2, 3) for k in range(len(raw) - n + 1)})
    assert langid._kernel(seen, seen).diagonal()[[0, 1]] == pytest.approx(1)
    assert (seen[0] <= seen[3]).all()


def test_attention_gradients():
    random = np.random.default_rng(0)
    figures, counts, labels = random.random((9, len(quality.FIGURES))), np.array([2, 1, 4, 2]), np.array([1.0, 0, 1, 0])
    model = quality.fit(figures, counts, labels, hidden=3, gates=2, epochs=1)

    def loss():
        p = learning.sigmoid(model.forward(figures, counts)["logit"])
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    for part, gradient in zip(model.parts, model.gradients(figures, counts, labels), strict=True):
        at = (0,) * part.ndim
        keep = part[at]
        part[at] = keep + 1e-5
        up = loss()
        part[at] = keep - 1e-5
        down = loss()
        part[at] = keep
        assert gradient[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_passage_figures():
    figures, counts = quality.passages(pa.array(["The THE cat 12 %% cat.\nde", "", None, "w " * 100]))
    assert counts.tolist() == [1, 1, 1, 3]
    named = dict(zip(quality.FIGURES, figures[0]))
    assert named["capitals"] == pytest.approx(4 / 14) and named["different"] == pytest.approx(6 / 7) and named["repeats"] == pytest.approx(1 / 7)
    assert named["lines"] == pytest.approx(1 / 7) and named["wordless"] == pytest.approx(2 / 7)
    assert not figures[1].any() and not figures[2].any()


def test_nnpu_turns_the_gradient_round():
    random = np.random.default_rng(1)
    positive, unlabelled = random.random((200, 5)) + [1, 0, 0, 0, 0], np.vstack([random.random((400, 5)), random.random((100, 5)) + [1, 0, 0, 0, 0]])
    w, b = toxicity.nnpu(positive, unlabelled, 0.2)
    assert (positive @ w + b > 0).mean() > 0.9 and (unlabelled[:400] @ w + b > 0).mean() < 0.1
