"""Line dedup: an exact set-similarity join of lines, with DataFrame functions only.

A line's set is its distinct words (lower case, cut at white space).  A line is removed where an earlier line, by
(doc_id, line number), has a Jaccard similarity of 0.75 or more; the first of a group of like lines stays.

Words are ordered by rarity: words are hashed to ``BUCKETS`` buckets, whose counts over all texts are exact, and
a word's place is its bucket's rank and then its hash.  That is one order for all lines, which is all the filters
need.  Lines with equal sets collapse to a class first.  Then

* prefix: linked sets share a word in the first  n - ceil(3n/4) + 1  of each,
* positional: linked sets differ in at most (n + m) / 7 words; at the first word they share, at places i and j, they differ in all
  i + j - 2 words before it, and after it at least in as many as n - i and m - j differ by, and as the parities of the
  common words differ in, where the shared word is a rare one,
* length: 4 n >= 3 m, and a bitmap: two parity bitmaps can't differ in more bits than the sets in words

are conditions of one join of the prefixes with themselves on the word, in one shuffle, made in ``PASSES`` parts so that only a part
of the prefixes is shuffled at a time.  A pair is only sought at its first shared word, so few pairs come twice.  What passes is
verified on the sets, first with each line's most alike partner, then, where that isn't enough, with its others.  Thousands of
variants of a line would make all their pairs pass, so before that a linear pass tries each class against the earliest class that shares
the least or the greatest hash of the prefix with it, in two orders.  A class that this removes needs no partner any more: in the join
it is only tried as the earlier line of a later class that is still there, never against another removed one.  Classes have
numbers in the order of lines, so that the join itself keeps to that.

Defined results: lines without words are never removed.  Null and empty texts stay as they are, with 0 and 0.
Rows with a null doc_id are documents of their own and come after all others.  Rows that share a doc_id, or have none,
come in the order of a hash of their text; rows that share both are one document.  Very long texts and lines are
treated as any other.  An empty table gives no rows.  Other columns of ``docs`` stay as they are, whatever their names
(but n_lines and n_removed, which are written, and names that begin with two underscores).
Words are compared by 63 bits of their hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

BUCKETS, PASSES = 1 << 16, 4
#: Of all words, the share that counts as rare: most words of a prefix are among them.
SHARE = 0.25
_LAST = 2**63 - 1
#: Identifies a line, in the order of lines.
_PLACE = ["doc", "text_hash", "line"]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _identified(docs: DataFrame) -> DataFrame:
    """doc, text_hash and text of each row."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(_text()).alias("text_hash"), _text().alias("text"))


def _plain(text: Column) -> Column:
    """In lower case, with blanks for all white space but the ends of lines."""
    odd = F.lit(False)
    for sign in "\t\r\x0b\x0c":
        odd |= F.contains(text, F.lit(sign))
    return F.lower(F.when(odd, F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")).otherwise(text))


def _ranks(docs: DataFrame) -> tuple[Column, int]:
    """A literal array: the rank of each bucket of words by its count; as long as BUCKETS, whatever the corpus.  And the
    least key of the words after the rarest ``SHARE`` of all."""
    words = docs.select(F.explode(F.split(F.replace(_plain(_text()), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counts = dict(words.groupBy(F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).count().collect())
    rank, rare, most = [0] * BUCKETS, 0, SHARE * sum(counts.values())
    bound = 0
    for i, b in enumerate(sorted(range(BUCKETS), key=lambda b: (counts.get(b, 0), b))):
        rank[b] = i >> 1  # 15 bits
        rare += counts.get(b, 0)
        if rare <= most:
            bound = i >> 1 << 48
    return F.split(F.lit(",".join(map(str, rank))), ",").cast("array<long>"), bound


def _keys(line: Column, ranks: Column) -> Column:
    """The words of a ``_plain`` line as numbers in the order of rarity: 15 bits of rank, 48 bits of hash."""

    def key(hashed: Column) -> Column:
        # never null: arrays without nulls are sorted as primitive numbers
        rank = F.coalesce(F.get(ranks, hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("long"))
        return F.shiftleft(rank, 48).bitwiseOR(F.shiftrightunsigned(hashed, 16))

    hashes = F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(F.array_remove(hashes, F.xxhash64(F.lit(""))), key))


def _parity(keys: Column, bound: int | None = None) -> Column:
    """64 bits, each the parity of the words that fall on it: of all words, or of those from ``bound`` on."""
    one = F.lit(1).cast("long")

    def step(held: Column, k: Column) -> Column:
        mine = one if bound is None else F.shiftrightunsigned(F.lit(bound - 1).cast("long") - k, 63)
        return held.bitwiseXOR(F.call_function("shiftleft", mine, k.bitwiseAND(F.lit(63)).cast("int")))

    return F.aggregate(keys, F.lit(0).cast("long"), step)


def _classes(docs: DataFrame, ranks: Column, bound: int) -> DataFrame:
    """A row for each different set: the place of its first line, n, prefix and the parities of all its words (bits) and of
    its common ones (common)."""
    lines = _identified(docs).select("doc", "text_hash", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line", "content"))
    sets = lines.select(*_PLACE, _keys(F.col("content"), ranks).alias("keys"))
    n = F.size("keys")
    prefix = F.slice("keys", 1, n - F.ceil(n * 3 / 4).cast("int") + 1)
    rows = sets.select(F.xxhash64("keys").alias("c"), F.hash("keys").alias("c2"), F.struct(*_PLACE).alias("first"), n.alias("n"), prefix.alias("prefix"), _parity(F.col("keys")).alias("bits"), _parity(F.col("keys"), bound).alias("common"))
    rows = rows.groupBy("c", "c2").agg(F.min("first").alias("first"), *(F.first(x).alias(x) for x in ("n", "prefix", "bits", "common")))
    return rows.where("n > 0").select("first.*", "n", "prefix", "bits", "common")


def _earlier(a: str, b: str) -> Column:
    """Whether the line of ``a`` comes before that of ``b``."""
    return F.struct(*(F.col(a + x) for x in _PLACE)) < F.struct(*(F.col(b + x) for x in _PLACE))


def _differ(a: str, b: str) -> Column:
    """Bits that two lines' 128 parities differ in: those of the common words, and of the others."""
    own, other = F.col(f"{a}common").bitwiseXOR(F.col(f"{b}common")), F.col(f"{a}bits").bitwiseXOR(F.col(f"{b}bits"))
    return F.bit_count(own) + F.bit_count(own.bitwiseXOR(other))


def _may_link(a: str, b: str) -> Column:
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (F.least(n, m) * 4 >= F.greatest(n, m) * 3) & (_differ(a, b) * 7 <= n + m)


def _prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(prefix + c) for c in rows.columns))


_SIDES = {side: [f"{side}_{c}" for c in _PLACE] for side in "xy"}


def _sets(pairs: DataFrame, docs: DataFrame, ranks: Column) -> DataFrame:
    """The sets of all lines of ``pairs``.  The texts are shuffled to the lines asked for."""
    ends = [pairs.select(*(F.col(c).alias(k) for c, k in zip(side, _PLACE, strict=True))) for side in _SIDES.values()]
    asked = ends[0].union(ends[1]).distinct().groupBy("doc", "text_hash").agg(F.collect_list("line").alias("asked"))
    # rows that share doc_id and text are one document
    lines = asked.join(_identified(docs), ["doc", "text_hash"]).select("doc", "text_hash", F.explode("asked").alias("line"), F.split("text", "\n").alias("lines"))
    sets = lines.select(*_PLACE, F.get("lines", F.col("line")).alias("content")).select(*_PLACE, _keys(_plain(F.col("content")), ranks).alias("keys"))
    return scratch.materialize(sets.dropDuplicates(_PLACE), "linesets")


def _matched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those later lines (their places) of ``pairs(x_..., y_...)`` whose sets link."""
    both = pairs.join(_prefixed(sets, "x_"), _SIDES["x"]).join(_prefixed(sets, "y_"), _SIDES["y"])
    shared = F.size(F.array_intersect("x_keys", "y_keys"))
    linked = both.where(shared * 4 >= (F.size("x_keys") + F.size("y_keys") - shared) * 3)
    return scratch.materialize(linked.select(*(F.col(c).alias(k) for c, k in zip(_SIDES["x"], _PLACE, strict=True))).distinct(), "matched")


def _stars(classes: DataFrame) -> DataFrame:
    """Each class with the earliest class of the same mark, where the two may link."""
    # two orders of the words that have nothing to do with the ranks
    shifted = lambda by: F.transform("prefix", lambda k: F.shiftleft(k, by))
    orders = [shifted(15), shifted(31)]
    marks = F.array_distinct(F.array(*(end(order) for order in orders for end in (F.array_min, F.array_max))))
    marked = classes.select(*_PLACE, "n", "bits", "common", marks.alias("marks")).select(*_PLACE, "n", "bits", "common", F.explode("marks").alias("mark"))
    earliest = marked.groupBy("mark").agg(F.min(F.struct(*_PLACE, "n", "bits", "common")).alias("e")).select("mark", *(F.col(f"e.{c}").alias(f"y_{c}") for c in (*_PLACE, "n", "bits", "common")))
    stars = _prefixed(marked, "x_").join(earliest, F.col("x_mark") == F.col("mark")).where(_earlier("y_", "x_") & _may_link("x_", "y_"))
    return stars.select(*(f"{side}_{c}" for side in "xy" for c in _PLACE)).distinct()


def _words(classes: DataFrame, turn: int) -> DataFrame:
    """A row for each word of the prefix that is in this turn; the lowest bit of code tells whether the class is still there."""
    code = F.shiftleft("o", 1).bitwiseOR(F.col("alive").cast("long"))
    rows = classes.select(code.alias("code"), "n", "bits", "common", F.posexplode("prefix").alias("place", "word"))
    return rows.where(F.pmod("word", F.lit(PASSES)) == turn).select("word", "code", "n", (F.col("place") + 1).alias("place"), "bits", "common")


def _near(classes: DataFrame, turn: int, bound: int) -> DataFrame:
    """Pairs (later, earlier) of classes that pass the filters on a shared word, with how much they differ; the later is
    still there."""
    rows = _words(classes, turn)
    n, m, i, j, x, y = (F.col(c) for c in ("x_n", "y_n", "x_place", "y_place", "x_code", "y_code"))
    # were this the first word shared, then all words before it would differ, and so many after it
    before, common = i + j - 2, F.bit_count(F.col("x_common").bitwiseXOR(F.col("y_common")))
    first = ((before + F.abs((n - i) - (m - j))) * 7 <= n + m) & (x.bitwiseAND(F.lit(1)) == 1) & ((F.col("x_word") >= bound) | ((before + common) * 7 <= n + m))
    # the cheapest first: a frequent word has many pairs
    passes = (x > y) & first & (_differ("x_", "y_") * 7 <= n + m)
    # coalesced, as bare comparisons would set one scan apart and shuffle the words twice
    pairs = _prefixed(rows, "x_").join(_prefixed(rows, "y_"), (F.col("x_word") == F.col("y_word")) & F.coalesce(passes, F.lit(False)))
    return pairs.select(F.shiftright(x, 1).alias("x"), F.shiftright(y, 1).alias("y"), (_differ("x_", "y_") / (n + m)).alias("differ")).distinct()


def removed_firsts(classes: DataFrame, places: DataFrame, docs: DataFrame, ranks: Column, bound: int) -> DataFrame:
    """The places of those first lines of classes that have an earlier match of another class; ``classes`` is a written table,
    which goes, and ``places`` their places and numbers."""
    stars = scratch.materialize(_stars(classes), "stars")
    sets = _sets(stars, docs, ranks)
    first = _matched(stars, sets)
    scratch.discard(stars, sets)
    marked = classes.join(places, _PLACE).join(first.withColumn("gone", F.lit(True)), _PLACE, "left").withColumn("alive", F.col("gone").isNull())
    marked = scratch.materialize(marked.select(*_PLACE, "n", "bits", "common", "prefix", "alive", "o"), "marked")
    scratch.discard(classes)
    pairs = [scratch.materialize(_near(marked, turn, bound), "near") for turn in range(PASSES)]
    ends = [_prefixed(places, f"{side}_") for side in "xy"]
    known = reduce(DataFrame.union, pairs).distinct().join(ends[0], F.col("x") == F.col("x_o")).join(ends[1], F.col("y") == F.col("y_o"))
    known = scratch.materialize(known.select("differ", *_SIDES["x"], *_SIDES["y"]), "linepairs")
    scratch.discard(marked, *pairs)
    sets = _sets(known, docs, ranks)
    best = known.groupBy(*_SIDES["x"]).agg(F.min(F.struct("differ", *_SIDES["y"])).alias("y")).select(*_SIDES["x"], *(f"y.{c}" for c in _SIDES["y"]))
    second = _matched(best, sets)
    rest = known.join(_prefixed(second, "x_"), _SIDES["x"], "left_anti").join(best, [*_SIDES["x"], *_SIDES["y"]], "left_anti")
    third = _matched(rest.drop("differ"), sets)
    scratch.discard(known, sets)
    return first.union(second).union(third)


def _kept(places: DataFrame, removed: DataFrame) -> DataFrame:
    """doc, text_hash and a bit for each line that stays, in numbers of 64 lines."""
    stay = places.join(removed, _PLACE, "left_anti").withColumn("block", F.col("line").bitwiseAND(F.lit(~63)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("line").bitwiseAND(F.lit(63)))
    blocks = stay.groupBy("doc", "text_hash", "block").agg(F.bit_or(bit).alias("bits"))
    held = blocks.groupBy("doc", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("held"), F.max("block").alias("most"))
    dense = F.transform(F.sequence(F.lit(0), F.col("most"), F.lit(64)), lambda b: F.coalesce(F.try_element_at("held", b), F.lit(0).cast("long")))
    return held.select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"), dense.alias("__kept"))


def _kept_lines(docs: DataFrame) -> DataFrame:
    ranks, bound = _ranks(docs)
    classes = scratch.materialize(_classes(docs, ranks, bound), "lineclasses")
    # numbers in the order of lines: range partitions come in order, and so do the rows of each
    places = classes.select(*_PLACE).repartitionByRange(scratch.partitions(docs.sparkSession), *_PLACE).sortWithinPartitions(*_PLACE)
    places = scratch.materialize(places.withColumn("o", F.monotonically_increasing_id()), "lineplaces")
    removed = removed_firsts(classes, places, docs, ranks, bound)
    kept = scratch.materialize(_kept(places.drop("o"), removed), "keptlines")
    scratch.discard(places)
    return kept


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with n_lines, n_removed, and text without the removed lines."""
    text = _text()
    with scratch.prompt(docs.sparkSession):
        kept = _kept_lines(docs)
    rows = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn("__hash", F.xxhash64(text))
    rows = rows.join(kept, ["__doc", "__hash"], "left")
    lines = rows.withColumn("__lines", F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n")))

    def stays(line: Column, i: Column) -> Column:
        held = F.coalesce(F.get("__kept", F.shiftright(i, 6)), F.lit(0).cast("long"))
        bit = F.call_function("shiftrightunsigned", held, i.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long"))
        return (bit == 1) | ~line.rlike(r"[^\x20\x09-\x0D]")

    lines = lines.withColumn("__left", F.filter("__lines", stays))
    cut = lines.withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_removed", (F.size("__lines") - F.size("__left")).cast("long"))
    return cut.withColumn("text", F.when(F.col("n_removed") > 0, F.array_join("__left", "\n")).otherwise(F.col("text"))).drop("__doc", "__hash", "__kept", "__lines", "__left")


SQL = r"""
WITH docs AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
lines AS (SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS content
          FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM docs WHERE text <> '')),
sets AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(content), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS words
         FROM lines),
classes AS (SELECT words, len(words) AS n, min(doc_id * 1000000 + line) AS first FROM sets WHERE len(words) > 0 GROUP BY words),
tokens AS (SELECT first, n, unnest(words) AS word FROM classes),
freq AS (SELECT word, count(*) AS f FROM tokens GROUP BY word),
ordered AS (SELECT first, n, t.word, row_number() OVER (PARTITION BY first ORDER BY f, t.word) AS place FROM tokens t JOIN freq USING (word)),
prefix AS (SELECT first, n, word FROM ordered WHERE place <= n - ceil(n * 3 / 4.0) + 1),
near AS (SELECT DISTINCT x.first AS a, y.first AS b FROM prefix x JOIN prefix y ON x.word = y.word AND x.first < y.first AND 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n)),
linked AS (SELECT DISTINCT b FROM near JOIN classes x ON a = x.first JOIN classes y ON b = y.first
           WHERE 4 * len(list_intersect(x.words, y.words)) >= 3 * (x.n + y.n - len(list_intersect(x.words, y.words)))),
kept AS (SELECT first FROM classes WHERE first NOT IN (SELECT b FROM linked)),
judged AS (SELECT l.doc_id, l.line, content, len(words) = 0 OR k.first IS NOT NULL AS stays
           FROM lines l JOIN sets s ON l.doc_id = s.doc_id AND l.line = s.line LEFT JOIN kept k ON k.first = l.doc_id * 1000000 + l.line),
cut AS (SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN stays THEN 0 ELSE 1 END) AS n_removed,
               COALESCE(string_agg(content, chr(10) ORDER BY line) FILTER (WHERE stays), '') AS text FROM judged GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(n_lines, 0) AS BIGINT) AS n_lines, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, COALESCE(c.text, d.text) AS text
FROM docs d LEFT JOIN cut c ON d.doc_id = c.doc_id
"""
