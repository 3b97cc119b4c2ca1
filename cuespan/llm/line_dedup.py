"""Operator 9 [native]: corpus-wide line deduplication.

Lines are exploded as 128-bit hashes of their keys and their positions (never as text),
written down once, and counted with map-side partial aggregation; only the positions to
drop travel back to the documents, where what lies between them is joined again.

A key is the line without ASCII white space at either end, A-Z lower-cased. Keys of at
least ``min_chars`` code points held by at least ``min_docs`` documents lose all their
lines except in the smallest doc_id that holds them.

Defined edge cases: a null or empty text is one empty line (kept as an empty text); rows
with one doc_id count as one document and are treated alike; a null doc_id orders after
all others and counts as one document; an empty table gives an empty result; further
columns pass through whatever they are called, and the operator's own (``n_lines``,
``n_dropped``) replace any of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import HOT_KEYS, NO_ID, hot_join, materialize, table

MIN_CHARS = 10
MIN_DOCS = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, h, pos, a, b): the lines with a key of ``min_chars``, by document (``NO_ID`` for a
    null id) and hash of its text (rows of one id may differ); a and b are 128 bits of the
    key, as 64 would confuse lines at 10^11 of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # long keys need long lines: a cheap test on the raw line comes before the key
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("x"))), lambda s: F.length(s["x"]) >= min_chars)
    keys = F.filter(F.transform(lines, lambda s: F.struct(s["pos"].alias("pos"), line_key(s["x"]).alias("k"))), lambda s: F.length(s["k"]) >= min_chars)
    hashes = F.transform(keys, lambda s: F.struct(s["pos"].alias("pos"), F.xxhash64(s["k"]).alias("a"), F.xxhash64(F.lit("second"), s["k"]).alias("b")))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), F.inline(hashes))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, h, drops): the positions, ascending, of the lines that a document loses."""
    held = materialize(line_hashes(docs, min_chars), "line-hashes")
    if min_docs == 2:  # two documents at least: the smallest and the largest id differ
        keep = held.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).filter("first < last").drop("last")
    else:
        per_doc = held.groupBy("a", "b", "id").agg(F.count("*").alias("n"))
        keep = per_doc.groupBy("a", "b").agg(F.min("id").alias("first"), F.count("*").alias("docs"), F.sum("n").alias("n")).filter(F.col("docs") >= min_docs).drop("docs")
    # a line of a boilerplate kind may be in a third of all documents: such keys are few
    keep, total = materialize(keep, "line-keys"), held.count()
    drops = hot_join(held, keep, ["a", "b"], F.col("n") * HOT_KEYS > total).filter("id > first")
    return drops.groupBy("id", "h").agg(F.array_sort(F.collect_set("pos")).alias("drops"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` cleaned, and ``n_lines`` and ``n_dropped`` added."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"))
    both = whole.join(dropped_lines(docs, min_chars, min_docs), ["id", "h"], "left")
    lines = F.split(F.coalesce(F.col("row")["text"], F.lit("")), "\n", -1)

    def between(s: Column) -> Column:
        """The lines between the dropped ones: as many slices as there are, and one more."""
        ends = F.concat(F.array(F.lit(-1)), s["drops"], F.array(F.size(s["lines"])))
        cuts = F.transform(F.array(F.struct(s["lines"].alias("lines"), ends.alias("ends"))), lambda e: F.flatten(F.transform(F.sequence(F.lit(1), F.size(s["drops"]) + 1), lambda k: F.slice(e["lines"], F.element_at(e["ends"], k) + 2, F.element_at(e["ends"], k + 1) - F.element_at(e["ends"], k) - 1))))
        return F.array_join(cuts[0], "\n")

    # transform over a one-element array splits a text once; most have nothing to drop
    n_dropped = F.coalesce(F.size("drops"), F.lit(0))
    bound = F.array(F.struct(lines.alias("lines"), F.col("drops").alias("drops")))
    kept = F.when(F.col("drops").isNull(), F.coalesce(F.col("row")["text"], F.lit(""))).otherwise(F.transform(bound, between)[0])
    return both.select(
        *[(kept if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size(lines).cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def oracle() -> str:
    return rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text,''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM l),
d AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY 1 HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT k.doc_id, pos, line, d.first IS NOT NULL AND k.doc_id > d.first AS gone FROM k LEFT JOIN d USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""
