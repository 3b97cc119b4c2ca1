"""Operator 2 [native]: document fingerprints by a threshold-scaled sketch.

A document's sketch retains every shingle hash below a fixed fraction of the hash range, a
sixteenth, the same for all documents, however short or long. So sketches merge by union, and
the overlap of a short and a very long document estimates containment without bias. A text
none of whose hashes is that small keeps its smallest one, which says by chance whether two
short texts are alike; merging keeps the rule, as the smallest of two is that of both.

A sketch has about n/16 hashes for n shingles, in base64 some 8 characters each: 7 % of the
text for words of six letters. The standard error of a likeness J is sqrt(J (1 - J) / m) for the
m hashes that both sketches retain together, so for J = 1/2 and texts of n shingles about
sqrt(2 / n): 0.14 at 100 shingles, 0.045 at 1,000, and a mere hint below 20.

Shingles are of five words (``[^\\x20\\x09-\\x0D]+``); a text with fewer words is one
shingle. Hashes have 48 bits and are written in six bytes each, smallest first.

The next document is found from ids alone: (id, hash of the text) is ranged and each row
looks one ahead. Then a document asks the next one for as much text as it needs, and for
its sketch. Texts are shuffled once, by (id, hash), for both of the joins.

Defined edge cases: a null text is an empty text, whose sketch is empty; two empty
sketches are alike to 1, an empty and another one to 0; null ids come last in descending
order, and rows with one id are ordered by a hash of their texts; rows equal in id and text
have one and the same next document, the one after all of them; a table of one such
document is its own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import WORD_GAP, materialize, ranged, table

SHINGLE = 5
FRACTION_BITS = 4  # retain hashes below 2^48 / 2^4
HASH_BITS = 48


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def retained(hashes: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """The hashes below the threshold, sorted; without any the smallest one there is."""
    low = F.filter(hashes, lambda h: h < F.lit(1 << (HASH_BITS - fraction_bits)))
    return F.when((F.size(low) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(F.array_sort(F.array_distinct(low)))


def sketch(text: Column, shingle: int = SHINGLE, fraction_bits: int = FRACTION_BITS) -> Column:
    """The sorted retained hashes of a text (array of longs)."""
    mask = (1 << HASH_BITS) - 1

    def of_words(ws: Column) -> Column:
        n = F.size(ws)
        starts = F.sequence(F.lit(1), F.greatest(n - (shingle - 1), F.lit(1)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, shingle)).bitwiseAND(F.lit(mask)))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.array(hashes), lambda h: retained(h, fraction_bits))[0])

    # transform over a one-element array binds the words once
    return F.transform(F.array(words_of(text)), of_words)[0]


def packed(hashes: Column) -> Column:
    """Six bytes a hash: what is shuffled of a sketch."""
    return F.unhex(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), HASH_BITS // 4, "0")), ""))


def fingerprint(hashes: Column) -> Column:
    """The sketch as text: its bytes in base64, on one line."""
    return F.translate(F.base64(packed(hashes)), "\r\n", "")


def unpacked(raw: Column) -> Column:
    width = HASH_BITS // 8
    number = lambda i: F.conv(F.hex(F.substring(raw, i * width + 1, width)), 16, 10).cast("long")
    return F.when(F.length(raw) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.call_function("div", F.length(raw), F.lit(width)).cast("int") - 1), number))


def merge(a: Column, b: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """The sketch of two texts' shingles together."""
    return F.transform(F.array(F.array_union(a, b)), lambda h: retained(h, fraction_bits))[0]


def _compared(a: Column, b: Column, rate) -> Column:
    """``rate`` of (hashes in both, in a, in b); transform binds what is used more than once."""
    sizes = F.array(F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(a).alias("x"), F.size(b).alias("y")))
    return F.transform(sizes, lambda s: rate(s["both"], s["x"], s["y"]))[0]


def jaccard(a: Column, b: Column) -> Column:
    return _compared(a, b, lambda both, x, y: F.when(x + y == 0, 1.0).otherwise(both / (x + y - both)))


def containment(a: Column, b: Column) -> Column:
    """Share of a's shingles that b has too."""
    return _compared(a, b, lambda both, x, y: F.when(x == 0, 1.0).otherwise(both / x))


KEY = ["id", "no_id", "h"]  # id (0 for a null one), whether it is null, hash of the text


def next_keys(keys: DataFrame) -> DataFrame:
    """``keys`` with ``then``, the KEY of the row after it in descending id (null ids last),
    ascending h; the last is followed by the first. ``keys`` has no repeated KEY."""
    order = [F.col("no_id"), F.col("id").desc(), F.col("h")]
    cut, _ = ranged(keys, order, "sketch-keys")
    # the first row of each range follows the last of the range before it: a row a range
    heads = cut.groupBy("part").agg(F.min_by(F.struct(*KEY), F.struct("no_id", (-F.col("id")).alias("down"), "h")).alias("head"))
    ahead = F.lead("head").over(W.orderBy("part"))
    around = F.first("head").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = heads.select("part", F.coalesce(ahead, around).alias("beyond"))
    led = cut.withColumn("ahead", F.lead(F.struct(*KEY)).over(W.partitionBy("part").orderBy(*order)))
    return led.join(F.broadcast(heads), "part").withColumn("then", F.coalesce("ahead", "beyond")).drop("part", "ahead", "beyond")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the edited text and the three sketches."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    keys = rows.groupBy(*KEY).agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("need"))
    asked = materialize(next_keys(keys), "sketch-next")
    asks = asked.select(*[F.col("then")[c].alias(c) for c in KEY], F.struct(*KEY).alias("by"), "need")
    told = rows.join(asks, KEY).select("by", F.substring("text", F.lit(1), F.col("need")).alias("start"), packed(sketch(F.col("text"))).alias("next_packed"))
    # one answer for each key, however often the next document is repeated
    told = told.select("by.*", "start", "next_packed").groupBy(*KEY).agg(F.max("start").alias("start"), F.max("next_packed").alias("next_packed"))
    both = rows.join(told, KEY)
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.col("start"))
    out = both.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"), sketch(F.col("text")).alias("sketch"), unpacked(F.col("next_packed")).alias("next_sketch"))
    return out.withColumn("edited_sketch", sketch(F.col("edited")))


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_pairs(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        jaccard(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        jaccard(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
