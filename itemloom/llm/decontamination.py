"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are runs of digits, letters and other non-ASCII signs, A-Z lowered. Of
every window of consecutive word grams the smallest hash is kept as fingerprint,
so two texts that share ``SPAN`` words in a row share a fingerprint inside the
span. Documents' and items' fingerprints are joined, and each hit is extended
word by word to both sides; it counts if the equal words reach ``SPAN``. Items
of fewer words are one window each: for the lengths that occur, every place of a
document is looked up.

A document's row carries one null fingerprint through the join, so documents
without hits stay and the text is read once. Null and empty texts have no
words; repeated rows come out as often as they went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.shared import settle

#: Words of a window, words of a gram, and grams of a winnowing window.
SPAN = 10
GRAM = 6
WINDOW = SPAN - GRAM + 1
AROUND = SPAN - GRAM
#: Low bits of a gram's hash that hold its place while minima are taken.
PLACE_BITS = 26
#: Up to so many fingerprints of items are broadcast; more are joined by shuffle.
BROADCAST = 200_000

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """A-Z lowered and all else unchanged; ``lower`` does the same on ASCII, faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _CAPITALS, _CAPITALS.lower()))


def _fingerprinted(df: DataFrame, short: list[int]) -> DataFrame:
    """Adds words, n_words, grams (hashes) and places: 16 * first word + length,
    where a fingerprint of the winnowing has length ``SPAN``."""
    df = df.withColumn("words", F.regexp_extract_all(lowered(F.coalesce("body", F.lit(""))), F.lit(WORDS), F.lit(0))).drop("body")
    n = F.size("words")
    # Arrays are read by place within the lambdas: slices would copy all of them each time.
    df = df.select("*", n.alias("n_words"), F.when(n >= SPAN, F.transform("words", lambda w: F.xxhash64(w))).alias("hashes"))
    longest = F.when(F.col("n_words") >= 1 << PLACE_BITS, F.raise_error(F.lit(f"a text has {1 << PLACE_BITS} words or more")).cast("int")).otherwise(F.col("n_words"))
    begins = F.sequence(F.lit(0), longest - GRAM)
    grams = F.when(F.col("hashes").isNotNull(), F.transform(begins, lambda i: F.xxhash64(*(F.get("hashes", i + j) for j in range(GRAM)))))
    df = df.select("*", grams.alias("grams")).drop("hashes")
    df = df.select("*", F.transform("grams", lambda g, i: g.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("long"))).alias("marked"))
    starts = F.sequence(F.lit(0), F.col("n_words") - SPAN)
    least = F.array_distinct(F.transform(starts, lambda i: F.least(*(F.get("marked", i + j) for j in range(WINDOW)))))
    chosen = F.transform(least, lambda m: m.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int") * 16 + SPAN)
    places = F.when(F.col("marked").isNull(), F.array().cast("array<int>")).otherwise(chosen)
    for length in short:
        every = F.sequence(F.lit(length), (F.col("n_words") - length) * 16 + length, F.lit(16))
        places = F.concat(places, F.when(F.col("n_words") >= length, every).otherwise(F.array().cast("array<int>")))
    return df.select("*", places.alias("places")).drop("marked")


def _hash(place: Column, length: Column, short: list[int]) -> Column:
    out = F.when(length == SPAN, F.get("grams", place))
    for own in short:
        out = out.when(length == own, F.xxhash64(F.slice("words", place + 1, own)))
    return out.otherwise(F.lit(0).cast("long"))


def _context(words: str, place: Column) -> Column:
    """The gram at ``place`` with the words around it; nulls beyond the text's ends."""
    return F.array(*(F.when(place + j >= 0, F.get(words, place + j)) for j in range(-AROUND, GRAM + AROUND)))


def item_fingerprints(items: DataFrame, key: str = "item_id", text: str = "text") -> tuple[DataFrame, list[int]]:
    """(item, length, hash, theirs: words around it) of benchmark items, and the
    lengths of their short items (at most nine numbers)."""
    counted = items.select(F.col(key).alias("item"), F.col(text).alias("body"))
    n = F.size(F.regexp_extract_all(lowered(F.coalesce("body", F.lit(""))), F.lit(WORDS), F.lit(0)))
    lengths = sorted(r.n for r in counted.select(n.alias("n")).where(f"n between 1 and {SPAN - 1}").distinct().collect())
    marked = _fingerprinted(counted, [])
    whole = F.when(F.col("n_words").between(1, SPAN - 1), F.array(F.col("n_words"))).otherwise(F.col("places"))
    found = marked.withColumn("place", F.explode(whole))
    place, length = F.floor(F.col("place") / 16).cast("int"), (F.col("place") % 16).cast("int")
    # A short item is one window at place 0, whose words are its context.
    return found.select("item", length.alias("length"), _hash(place, length, lengths).alias("hash"), F.when(length == SPAN, _context("words", place)).otherwise(F.col("words")).alias("theirs")), lengths


def find_hits(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, text_hash, n_words, first, last, item): each verified span of a
    document, and for each row of ``documents`` one row without a span."""
    prints, short = item_fingerprints(items, item_key, item_text)
    prints = settle(prints, "item-fingerprints")
    spark = documents.sparkSession
    mark = spark.range(1).select(F.lit(None).cast(prints.schema["item"].dataType).alias("item"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("hash"), F.array().cast("array<string>").alias("theirs"))
    small = prints.count() <= BROADCAST
    source = documents.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("body"))
    placed = _fingerprinted(source, short).withColumn("place", F.explode(F.concat("places", F.array(F.lit(-16))))).drop("places")
    place, length = F.floor(F.col("place") / 16).cast("int"), F.pmod("place", F.lit(16)).cast("int")
    placed = placed.select("key", "text_hash", "n_words", "words", "grams", place.alias("place"), length.alias("length"))
    mine = F.when(F.col("length") == SPAN, _context("words", F.col("place"))).when(F.col("length") > 0, F.slice("words", F.col("place") + 1, F.col("length")))
    placed = placed.select("key", "text_hash", "n_words", "place", "length", _hash(F.col("place"), F.col("length"), short).alias("hash"), mine.alias("mine"))
    if small:
        met = placed.join(F.broadcast(prints.unionByName(mark)), ["length", "hash"])
    else:
        # The rows that stand for whole texts meet nothing, and are spread by the texts' hashes.
        spread = F.when(F.col("length") == 0, F.xxhash64("key", "text_hash")).otherwise(F.col("hash"))
        met = placed.withColumn("hash", spread).join(prints, ["length", "hash"], "left").where("length = 0 OR item IS NOT NULL OR theirs IS NOT NULL")

    def reach(steps: list[int]) -> Column:
        """How many words in a row are equal, from the gram outwards."""
        total, so_far = F.lit(0), F.lit(True)
        for j in steps:
            so_far = so_far & F.coalesce(F.get("mine", F.lit(j)) == F.get("theirs", F.lit(j)), F.lit(False))
            total = total + so_far.cast("int")
        return total

    left, right = reach([*range(AROUND - 1, -1, -1)]), reach([*range(AROUND + GRAM, AROUND + GRAM + AROUND)])
    same = F.slice("mine", AROUND + 1, GRAM) == F.slice("theirs", AROUND + 1, GRAM)
    met = met.select("key", "text_hash", "n_words", "place", "length", "item", F.when(F.col("length") == SPAN, same).otherwise(F.col("mine") == F.col("theirs")).alias("same"), left.alias("left"), right.alias("right"))
    long = F.col("length") == SPAN
    met = met.where((F.col("length") == 0) | F.col("same") & (~long | (F.col("left") + F.col("right") + GRAM >= SPAN)))
    first = F.when(long, F.col("place") - F.col("left")).when(F.col("length") > 0, F.col("place"))
    last = F.when(long, F.col("place") + GRAM - 1 + F.col("right")).when(F.col("length") > 0, F.col("place") + F.col("length") - 1)
    return met.select("key", "text_hash", "n_words", first.alias("first"), last.alias("last"), "item").withColumnRenamed("key", key)


def report(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text_hash, n_words, n_hit, items: array of strings) for each document row."""
    one = F.col("first").isNull()
    grouped = hits.groupBy(key, "text_hash", "n_words").agg(
        F.sum(one.cast("int")).alias("copies"),
        F.collect_set(F.when(~one, F.struct("first", "last"))).alias("spans"),
        F.collect_set(F.col("item").cast("string")).alias("items"),
    )
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))
    return grouped.select(key, "text_hash", F.col("n_words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_hit"), F.array_sort("items").alias("items"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, s)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
