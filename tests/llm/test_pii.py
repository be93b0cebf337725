import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spatialrank.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, word):
    digits = re.sub("[^0-9]", "", word)
    if kind == "ip":
        return all(int(p) <= 255 for p in word.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(PATTERNS[kind], text or "", re.ASCII) if passes(kind, m[0])]
    return sorted(spans)


def told(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.digest(pii.detect(docs)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in want) for n in range(4)], t
        assert got[i].base_sha256 == hashlib.sha256(told(want).encode()).hexdigest(), t
        assert set(filter(None, told(want).split(","))) <= set(got[i].spans.split(","))
    return got


TEXTS = [
    None, "", "a@b.c", "x@y@z.com and a.b+c@d-e.f.g. _q@r.s_d@e.f", "é\U0001f600 mail: jo@x.org, tel +1 (706) 555-3138.", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.2.03 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000 4111111111111111", "+1 2 3 +123456789 +1234567890123456 +49 (0)30 123456-", "+12345678901234 5678", "9" * 60_000, "1 " * 40_000, "+1(" * 20_000 + "5", "a" * 100_000 + "@", "1." * 50_000,
    "call 706 555 0138 or 706-555-0139", "write to jo (at) mail (dot) example (dot) com", "@@ ++1 .. 1..2.3.4 a@b..c a@-.-", "\n".join(f"u{i}@h{i}.com 10.0.0.{i}" for i in range(300)),
]


def test_base_spans(spark):
    got = check(spark, TEXTS)
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert got[4].spans == "email:9:17,phone:23:40"


PIECES = ["a", "b.c", "@", ".", "-", " ", "+", "1", "23", "(", ")", "255", "256", "4111111111111111", "com", "é", "%", "_", "\n", "0", "+49", "\U0001f600"]


def test_any_text(spark):
    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=60, max_size=80))
    def inner(texts):
        check(spark, texts)

    inner()


def test_labelers_are_weighed():
    # the first two labelers agree, the third is noise, the fourth never votes
    digit = lambda *v: sum(x * 3**j for j, x in enumerate(v))
    counts = {digit(2, 2, 2, 1): 100, digit(2, 2, 0, 1): 100, digit(0, 0, 2, 1): 200, digit(0, 0, 0, 1): 200, digit(2, 0, 2, 1): 5, digit(0, 2, 0, 1): 5}
    group = (3, False)
    chance, right = pii.reliabilities({(group, p): n for p, n in counts.items()}, 4)
    share = sum(n * chance[group, p] for p, n in counts.items()) / sum(counts.values())
    assert chance[group, digit(2, 2, 0, 1)] > 0.95 and chance[group, digit(0, 0, 2, 1)] < 0.05 and 0.25 < share < 0.42
    assert right[0][0] > 0.9 > 0.1 > right[0][1] and 0.4 < right[2][0] < 0.6
    p = pii.classifier([(3, 36, 0.95, 100.0), (3, 1, 0.05, 300.0), (0, 5, 0.9, 10.0)])
    assert p[3, 36] > 0.7 and p[3, 1] < 0.3


def test_looser_spans_are_added_and_decoys_are_not(spark):
    base = ["mail jo%d@site.example.com", "phone +1 (706) 555-%04d now", "host 144.137.%d.239 up", "card 4111 1111 1111 1111 (%d)"]
    planted = ["call me at 706 555 1%03d today", "phone: (415) 555-2%03d", "write to jo%d (at) mail (dot) example (dot) com", "the host 144[.]137[.]2[.]%d answers", "pay by card 4111.1111.1111.1111 (%d)"]
    decoys = ["order 106 155 1%03d was shipped", "serial 123-045-6%03d", "version 300.400.500.%d", "invoice 4111 1111 1111 1112 (%d)", "lot 1234_5678_9012_34%d"]
    kinds = (("plain", base), ("planted", planted), ("decoy", decoys))
    rows = [(kind, t % i) for i in range(40) for kind, texts in kinds for t in texts]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    added = {kind: [len(got[i].added) for i, (k, _) in enumerate(rows) if k == kind] for kind, _ in kinds}
    assert sum(added["planted"]) >= 0.95 * len(added["planted"]) and sum(added["decoy"]) <= 0.02 * len(added["decoy"]) and not sum(added["plain"])
