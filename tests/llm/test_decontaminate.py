import numpy as np
import pytest

from spatialrank.llm import decontaminate as d


def nearest(item, text):
    """Least edits between ``item`` and any substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(last[j - 1] + (c != t), last[j] + 1, row[j - 1] + 1)
    return min(row)


def mutated(random, text, edits):
    text = list(text)
    for _ in range(edits):
        at = int(random.integers(0, len(text)))
        kind = random.integers(0, 3)
        if kind == 0:
            text[at] = chr(97 + int(random.integers(0, 26)))
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, chr(97 + int(random.integers(0, 26))))
    return "".join(text)


def made(seed):
    random = np.random.default_rng(seed)
    prose = lambda n: " ".join("".join(random.choice(list("abcdeé"), int(random.integers(1, 7)))) for _ in range(n))
    items = [prose(int(random.integers(3, 40))) for _ in range(12)]
    items += [items[0], "ab", "", None]
    texts = [prose(int(random.integers(1, 150))) for _ in range(15)]
    for item in items[:12]:
        e = d.edits(len(d.normal(item)))
        for n in (0, e // 2, e, e + 1, 2 * e + 3):
            texts.append(prose(int(random.integers(0, 30))) + " " + mutated(random, item, n) + "\n" + prose(int(random.integers(0, 30))))
    texts += [items[1], items[1][:-1], items[2].upper().replace(" ", " \n\t"), items[3] + items[3] + " x " + items[3], "", None, "a" * 5, "ab " * 30000 + items[4]]
    return items, texts


@pytest.mark.parametrize("seed", [0, 1])
def test_like_brute_force(spark, seed, monkeypatch):
    if seed:
        monkeypatch.setattr(d, "BLOCK", 300)
    items, texts = made(seed)
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i if i != 3 else None, t, 0) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in d.leaks(docs, bench).collect()), key=str)
    want = []
    for i, t in [*enumerate(texts), (5, texts[5])]:
        for k, item in enumerate(items):
            a, b = d.normal(item), d.normal(t)
            if len(a) >= d.Q:
                n = 0 if a in b else nearest(a, b[-3000:]) if d.edits(len(a)) else 1
                if n <= d.edits(len(a)):
                    want.append((i or None, k if k != 3 else None, n))
            elif a and a in b:
                want.append((i or None, k if k != 3 else None, 0))
    assert got == sorted(want, key=str) and len(want) > 30
    assert d.leaks(docs.limit(0), bench).count() == 0 and d.leaks(docs, bench.limit(0)).count() == 0


def test_aligned_place():
    a, b = np.frombuffer(b"hello brave world", np.uint8), np.frombuffer(b"xx hello brxve wrld yy", np.uint8)
    assert d.align(a, b, 3) == (3, 19, 2)
    assert d.align(a, b, 1) is None and d.align(a, b[:4], 2) is None
