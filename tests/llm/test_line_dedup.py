import re

import numpy as np
import pytest

from spatialrank.llm import line_dedup


def brute(rows):
    """Compare every line with every earlier one."""
    split = {k: t.split("\n") if t else [] for k, t in rows}
    earlier, out = [], {}
    for k in sorted(split, key=lambda k: (k is None, k)):
        kept = []
        for line in split[k]:
            words = frozenset(filter(None, re.split(r"[\x20\x09-\x0D]+", line.lower())))
            gone = bool(words) and any(4 * len(words & e) >= 3 * len(words | e) for e in earlier)
            if words:
                earlier.append(words)
            if not gone:
                kept.append(line)
        out[k] = (len(split[k]), len(split[k]) - len(kept), rows_text(rows, k) if len(kept) == len(split[k]) else "\n".join(kept))
    return out


def rows_text(rows, k):
    return next(t for q, t in rows if q == k)


def made(seed):
    random = np.random.default_rng(seed)
    line = lambda n: [f"w{int(x)}" for x in random.zipf(1.3, n) % 300]
    base, texts = [line(int(random.integers(1, 25))) for _ in range(60)], []
    for _ in range(60):
        text = []
        for _ in range(int(random.integers(1, 7))):
            words = list(base[int(random.integers(0, 60))]) if random.random() < 0.6 else line(int(random.integers(1, 25)))
            for _ in range(int(random.integers(0, 1 + len(words) // 5))):
                words[int(random.integers(0, len(words)))] = f"v{int(random.integers(0, 500))}"
            text.append((" " if random.random() < 0.8 else "\t ").join(words))
        texts.append("\n".join(text))
    return list(zip(random.permutation(len(texts)).tolist(), texts))


@pytest.mark.parametrize("seed", [0, 1])
def test_like_brute_force(spark, seed):
    rows = made(seed) + [(None, "w1 w2 w3 w4\nnew line here"), (900, None), (901, ""), (902, "\n \n\n"), (903, "UPPER case Line\n\nupper CASE line"), (904, "upper case\tline"), (905, "x " * 50_000), (906, "\n".join(f"l{i} a{i} b{i}" for i in range(1500))), (907, "é ü\nÉ ü\nñ")]
    docs = spark.createDataFrame([(k, t, 1, "q") for k, t in rows], "doc_id long, text string, line int, word string")
    out = line_dedup.dedup(docs)
    assert set(out.columns) == {"doc_id", "text", "line", "word", "n_lines", "n_removed"}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()} == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d\nq"), (1, "a b c d\nq"), (2, "A b c d\nz")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed, r.text) for r in line_dedup.dedup(docs).collect()) == [(1, 0, "a b c d\nq"), (1, 0, "a b c d\nq"), (2, 1, "z")]
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_a_removed_line_is_only_an_earlier_partner(spark, monkeypatch):
    group = [(100 + i, " ".join(f"g{(i * 7 + j) % 9}x{j}" if j in (i % 12, i % 5) else f"g{j}" for j in range(12))) for i in range(60)]
    rows, kept, write = made(2) + group, [], line_dedup.scratch.materialize

    def noted(df, name):
        out = write(df, name)
        if name in ("marked", "near"):
            kept.append((name, out.collect()))
        return out

    monkeypatch.setattr(line_dedup.scratch, "materialize", noted)
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()} == brute(rows)
    (marked,) = (found for name, found in kept if name == "marked")
    by = {r.o: r for r in marked}
    place = lambda o: (by[o].doc, by[o].text_hash, by[o].line)
    pairs = [r for name, found in kept if name == "near" for r in found]
    assert pairs and len(by) == len(marked) and not all(r.alive for r in marked)
    assert all(by[r.x].alive and place(r.y) < place(r.x) for r in pairs)


def test_variants_that_just_miss_a_link_are_few_candidates(spark, monkeypatch):
    # any two have at most one changed word in the same place: 22 or 24 words differ, where 18 might
    rows, made, write = [], {}, line_dedup.scratch.materialize
    for i in range(121):
        words = [f"t{j}" for j in range(66)]
        for k in range(6):
            words[11 * k + (i // 11 * k + i) % 11] = f"u{i}x{k}"
        rows.append((i, " ".join(words)))

    def noted(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup.scratch, "materialize", noted)
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = brute(rows)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()} == expected
    assert not any(removed for _, removed, _ in expected.values())
    # of 7,260 pairs
    assert made["linepairs"] < 1500 and made["near"] < 2000


def test_shuffle_files_setting_is_as_before(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), line_dedup.scratch.prompt(spark):
        assert spark.conf.get(key) == "true"
        1 / 0  # noqa: B018
    assert spark.conf.get(key) == before
