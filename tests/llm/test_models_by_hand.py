"""The three trained models against plain computations."""

import math

import numpy as np
import pyarrow as pa
import pytest

from spatialrank.llm import langid, quality, toxicity


def risk(zp, zu, prior):
    s = lambda z: 1 / (1 + math.exp(-z))
    as_positive = sum(1 - s(z) for z in zp) / len(zp)
    as_negative = sum(s(z) for z in zp) / len(zp)
    unlabelled = sum(s(z) for z in zu) / len(zu)
    return prior * as_positive, unlabelled - prior * as_negative


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_slopes_are_those_of_the_risk(prior):
    random = np.random.default_rng(1)
    zp, zu = random.normal(1, 1, 7), random.normal(-1, 1, 9)
    below = risk(zp, zu, prior)[1] < 0
    assert below == (prior == 0.9)
    followed = lambda a, b: -risk(a, b, prior)[1] if below else sum(risk(a, b, prior))
    slopes, h = np.concatenate(toxicity.risk_slopes(zp, zu, prior)), 1e-6
    for i, slope in enumerate(slopes):
        z = np.concatenate([zp, zu])
        up, down = z.copy(), z.copy()
        up[i] += h
        down[i] -= h
        assert slope == pytest.approx((followed(up[:7], up[7:]) - followed(down[:7], down[7:])) / (2 * h), abs=1e-8)


def test_positives_among_unlabelled_are_found():
    random = np.random.default_rng(2)
    positive = random.normal(1.5, 1, (300, 4))
    hidden, clean = random.normal(1.5, 1, (100, 4)), random.normal(-1.5, 1, (400, 4))
    w, b = toxicity.nnpu(positive, np.vstack([hidden, clean]), 0.2)
    assert (hidden @ w + b > 0).mean() > 0.97 and (clean @ w + b < 0).mean() > 0.97


TEXTS = ["the cat sat on the mat", "a dog and the cat", "der hund und die katze", "die maus ist klein", "le chat est la", "un chien et le rat", "THE Mat, 3 dogs", "und klein"]
LANGUAGES = ["en", "en", "de", "de", "fr", "fr", "en", "de"]


def test_kernel_ridge_like_the_dense_solution():
    grams = [{place for place in np.flatnonzero(row)} for row in langid.presence(pa.array(TEXTS))]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    # every text a landmark: the Nystroem features span the kernel, the constant has a ridge as any other
    names = sorted(set(LANGUAGES))
    model = langid.fit(langid.presence(pa.array(TEXTS)), LANGUAGES, landmarks=3 * len(TEXTS), ridge=0.01)
    targets = np.array([[1.0 if own == name else -1.0 for name in names] for own in LANGUAGES])
    with_constant = kernel + 1
    dense = with_constant @ np.linalg.solve(with_constant + 0.01 * len(TEXTS) / len(names) * np.eye(len(TEXTS)), targets)
    order, score = model.predict(langid.presence(pa.array(TEXTS)))
    assert [names[i] for i in order] == [names[i] for i in dense.argmax(1)] == LANGUAGES
    assert score == pytest.approx(np.clip((dense.max(1) + 1) / 2, 0, 1), abs=1e-3)


def test_grams_by_hand():
    texts = ["ab", "Ab c", "é1", "", None]
    for text, row in zip(texts, langid.presence(pa.array(texts)), strict=True):
        data = bytes(c if c >= 128 or 97 <= c < 123 else 32 for c in (text or "").lower().encode())
        places = set()
        for n in range(1, langid.ORDERS + 1):
            for i in range(len(data) - n + 1):
                gram = int.from_bytes(data[i : i + n], "big")
                places.add(((gram * 2654435761 + n * 40503) % 2**32 * 0x85EBCA6B % 2**32) >> 20)
        assert set(np.flatnonzero(row)) == places


def test_attention_like_plain_loops():
    random = np.random.default_rng(4)
    figures, counts = random.normal(size=(9, len(quality.FIGURES))).astype(np.float32), np.array([1, 5, 3])
    labels = np.array([0.0, 1.0, 1.0])
    model = quality.fit(figures, counts, labels, hidden=4, gates=3, epochs=2)
    e, f, v, u, w, c, d = model.parts
    got, at = model.forward(figures, counts)["logit"], 0
    for bag, n in enumerate(counts):
        hidden, energy = [], []
        for k in range(at, at + n):
            x = [min(8, max(-8, (float(figures[k, j]) - model.centre[j]) / model.scale[j])) for j in range(figures.shape[1])]
            h = [math.tanh(sum(x[j] * e[j, i] for j in range(len(x))) + f[i]) for i in range(4)]
            gate = [math.tanh(sum(h[i] * v[i, g] for i in range(4))) / (1 + math.exp(-sum(h[i] * u[i, g] for i in range(4)))) for g in range(3)]
            hidden.append(h)
            energy.append(math.exp(sum(gate[g] * w[g] for g in range(3))))
        mixed = [sum(a * h[i] for a, h in zip(energy, hidden, strict=True)) / sum(energy) for i in range(4)]
        assert got[bag] == pytest.approx(sum(mixed[i] * c[i] for i in range(4)) + d[0], abs=1e-9)
        at += n
