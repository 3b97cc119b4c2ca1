"""Operator 10: token totals kept by delta.

A batch of changes (insert, delete, revise) becomes signed additive rows by source,
language and tokenizer version; the totals are the sum over committed batches and are
never recounted. Texts are read once, by ``measured``; batches are made of its narrow rows.

A batch is written to a folder of its own attempt and counts from the moment its marker is
renamed to ``batches/<id>``, which no second attempt can do: a batch that is sent again,
or by two drivers at once, or again after a half-written attempt, changes the totals
exactly once. ``compact`` folds the batches of one listing into a snapshot that names the
ids it holds, so replays stay without effect; ``vacuum`` removes what no reader needs.

Only the Hadoop file system of the session is used: the store lives wherever Spark reads.
The rename is as atomic as that file system's; on a store without it, one driver commits.

Defined edge cases: a null text has 0 tokens; null sources and languages are keys of
their own; repeated rows count each time; an empty batch commits and changes nothing; a
revise with an unknown old version just takes its old count off that version; keys whose
documents and tokens are both zero are left out of the totals; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, scratch_path, some_rows, table
from .packing import WordCachedTokenizer

KEYS = ("source", "lang", "tokenizer_version")
DELTA = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode's white space
PIECE = re.compile(f"[{SPACE}]+[^{SPACE}]*|[^{SPACE}]+")
VOCABULARIES = ("word_bpe_49k", "byte_bpe_50k")
BATCH_TEXTS = 256


def words_v1(text: Column) -> Column:
    """Tokenizer version ``words-1``: runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def words_v2(text: Column) -> Column:
    """Tokenizer version ``words-2``: as ``words-1``, and each ASCII mark is a token too."""
    t = F.coalesce(text, F.lit(""))
    return (words_v1(F.translate(t, MARKS, " " * len(MARKS))) + F.length(t) - F.length(F.translate(t, MARKS, ""))).cast("long")


TOKENIZERS = {"words-1": words_v1, "words-2": words_v2}


class CachedCounter:
    """How many ids a tokenizer file gives texts, from those of their distinct pieces.

    A piece is a run of white space with what follows it up to the next one. No rule of these
    vocabularies joins characters across the start of such a run, so ids of pieces are ids of
    the text, and each piece is encoded once for a worker; beyond ``limit`` all are forgotten."""

    def __init__(self, path: str, limit: int = 200_000) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.encoder, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        self.encoder.encode_special_tokens = True  # their strings in a text are ordinary text

    def counts(self, texts: list[str]) -> list[int]:
        pieces = [PIECE.findall(t) for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        fresh = list({p for some in pieces for p in some if p not in self.known})
        for at in range(0, len(fresh), 1024):
            part = fresh[at : at + 1024]
            for p, e in zip(part, self.encoder.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[p] = len(e.ids)
        return [sum(map(self.known.__getitem__, some)) for some in pieces]


def counter_of(path: str) -> Callable[[pa.Array], list[int]]:
    """Counts of an Arrow array of texts, by the faster way that the vocabulary allows."""
    from tokenizers import Tokenizer

    if any(t.endswith("</w>") for t in Tokenizer.from_file(path).get_vocab()):  # a vocabulary of words
        cached = WordCachedTokenizer(path)
        cached.encoder.encode_special_tokens = True
        return lambda texts: cached.many(texts)[1].tolist()
    counter = CachedCounter(path)
    return lambda texts: counter.counts([t or "" for t in texts.to_pylist()])


def _vocabulary_counts(rows: DataFrame, path: str, to: str) -> DataFrame:
    """``rows`` with the number of ids that the tokenizer file at ``path`` gives each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(path)
        for part in some_rows(batches, BATCH_TEXTS):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(count(part.column("text")), pa.int64())], names=[*part.schema.names, to])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, {to} long")


def measured(docs: DataFrame, versions: dict[str, str | None]) -> DataFrame:
    """doc_id, source, lang and ``tokens``, a map from tokenizer version to count.

    ``versions`` names each version's tokenizer file, or None for one of TOKENIZERS."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    counts: dict[str, Column] = {}
    for k, (version, path) in enumerate(versions.items()):
        if path is None:
            counts[version] = TOKENIZERS[version](F.col("text"))
        else:
            rows = _vocabulary_counts(rows, path, f"n{k}")
            counts[version] = F.col(f"n{k}")
    return rows.select("doc_id", "source", "lang", F.create_map(*[x for v, n in counts.items() for x in (F.lit(v), n)]).alias("tokens"))


def counted(rows: DataFrame, version: str, op: str = "insert") -> DataFrame:
    """Change rows that insert (or delete) measured ``rows`` under a tokenizer version."""
    return rows.select(
        F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"),
        F.col("tokens")[version].alias("n_tokens"), F.lit(None).cast("string").alias("old_tokenizer_version"), F.lit(None).cast("long").alias("old_n_tokens"),
    )


def recounted(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Change rows that take measured ``rows`` from one tokenizer version to another."""
    return rows.select(
        F.lit("revise").alias("op"), "doc_id", "source", "lang", F.lit(new).alias("tokenizer_version"),
        F.col("tokens")[new].alias("n_tokens"), F.lit(old).alias("old_tokenizer_version"), F.col("tokens")[old].alias("old_n_tokens"),
    )


def signed_deltas(changes: DataFrame) -> DataFrame:
    """Additive rows of a batch: one for each key, summed map-side first."""
    part = lambda version, docs, tokens: F.struct(F.col(version).alias("tokenizer_version"), F.lit(docs).cast("long").alias("d_docs"), tokens.cast("long").alias("d_tokens"))
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_n_tokens", F.lit(0))
    parts = (
        F.when(F.col("op") == "insert", F.array(part("tokenizer_version", 1, new)))
        .when(F.col("op") == "delete", F.array(part("tokenizer_version", -1, -new)))
        .when(F.col("op") == "revise", F.array(part("tokenizer_version", 1, new), part("old_tokenizer_version", -1, -old)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))))
    )
    rows = changes.select("source", "lang", F.inline(parts))
    return rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))


class TokenRollup:
    """The store of committed batches below one folder: ``attempts/<name>`` has data, and
    the marker files ``batches/<id>`` and ``snapshots/<number>`` say which attempt counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p, fs = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(".")) if fs.exists(p) else []

    def _attempt(self, folder: str, name: str) -> str:
        """The attempt that a marker stands for."""
        p, fs = self._fs(f"{self.path}/{folder}/{name}")
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode().rstrip("\n").split("\t")[1]
        finally:
            stream.close()

    def _claim(self, folder: str, name: str, attempt: str) -> bool:
        """Make ``attempt`` what ``folder/name`` stands for; False if that is taken."""
        draft, fs = self._fs(f"{self.path}/attempts/{attempt}.marker")
        out = fs.create(draft, True)
        out.write(bytearray(f"{name}\t{attempt}\n".encode()))
        out.close()
        to, _ = self._fs(f"{self.path}/{folder}/{name}")
        fs.mkdirs(to.getParent())
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, to, none)  # without overwriting
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            fs.delete(draft, False)
            return False
        return True

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The last snapshot's folder, and the batches that it holds: names, no data."""
        marks = self._names("snapshots")
        if not marks:
            return None, set()
        last = f"{self.path}/attempts/{self._attempt('snapshots', marks[-1])}"
        held = self.spark.read.schema("batch_id string").parquet(f"{last}/ids")
        return last, {r.batch_id for r in held.collect()}

    def _after(self, held: set[str]) -> dict[str, str]:
        """Batches that aren't in ``held``, with their attempts: of the markers of all time
        only the names are listed, and only these are opened."""
        return {b: self._attempt("batches", b) for b in self._names("batches") if b not in held}

    def is_committed(self, batch_id: str) -> bool:
        p, fs = self._fs(f"{self.path}/batches/{batch_id}")
        return bool(fs.exists(p))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once. False, and no effect, if it was committed before."""
        if not batch_id or batch_id[0] in "._" or set(batch_id) & set("/\t\n"):
            raise ValueError("a batch id is a name without '/', tab or line end, and begins with neither '.' nor '_'")
        if self.is_committed(batch_id):
            return False
        attempt = uuid.uuid4().hex
        signed_deltas(changes).write.parquet(f"{self.path}/attempts/{attempt}")
        if self._claim("batches", batch_id, attempt):
            return True
        self._remove(attempt)
        return False

    def _remove(self, attempt: str) -> None:
        p, fs = self._fs(f"{self.path}/attempts/{attempt}")
        fs.delete(p, True)

    def _view(self) -> tuple[DataFrame, set[str]]:
        """Additive rows and the ids of the batches in them, of one and the same listing:
        the snapshot comes first, and what is committed later is not in it."""
        snap, held = self._snapshot()
        marks = self._after(held)
        paths = [f"{self.path}/attempts/{a}" for a in marks.values()] + ([f"{snap}/totals"] if snap else [])
        parts = [self.spark.read.schema(DELTA).parquet(*paths)] if paths else []
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], DELTA), held | set(marks)

    def deltas(self) -> DataFrame:
        return self._view()[0]

    def totals(self) -> DataFrame:
        out = self.deltas().groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return out.filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Fold the committed batches into a new snapshot; False if another was faster."""
        number = f"{len(self._names('snapshots')):012d}"
        rows, ids = self._view()
        attempt = uuid.uuid4().hex
        to = f"{self.path}/attempts/{attempt}"
        rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.parquet(f"{to}/totals")
        self.spark.createDataFrame([(x,) for x in sorted(ids)], "batch_id string").coalesce(1).write.parquet(f"{to}/ids")
        if self._claim("snapshots", number, attempt):
            return True
        self._remove(attempt)
        return False

    def vacuum(self) -> None:
        """Remove the data of folded batches, old snapshots and attempts without a marker.
        To be called while no reader and no writer is at work; markers stay."""
        snap, held = self._snapshot()
        used = set(self._after(held).values()) | ({snap.rsplit("/", 1)[1]} if snap else set())
        for name in self._names("attempts"):
            if name not in used:
                self._remove(name)


def _rolled(spark: SparkSession, sf_dir: str, versions: dict[str, str | None]) -> DataFrame:
    """Totals after four batches, two of them sent twice: all documents arrive, counted by the
    first of two ``versions``; those labelled toxic go; what is left in English is counted
    anew by the second."""
    old, new = versions
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    # only what will be counted anew is counted twice
    both = measured(docs.filter(english), versions).unionByName(measured(docs.filter(~english), {old: versions[old]}))
    rows = materialize(both, "token-counts")
    store = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    store.commit("0001-load", counted(rows, old))
    store.commit("0001-load", counted(rows, old))
    store.commit("0002-toxic", counted(rows.join(toxic, "doc_id", "left_semi"), old, "delete"))
    store.compact()
    store.commit("0003-english", recounted(rows.filter("lang = 'en'").join(toxic, "doc_id", "left_anti"), old, new))
    store.commit("0002-toxic", counted(rows, old, "delete"))
    return store.totals()


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by two vocabularies, a word and a byte one."""
    import public_tokenizers

    return _rolled(spark, sf_dir, {v: public_tokenizers.path(f"{v}.json") for v in VOCABULARIES})


def word_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches by two word rules, which SQL can check."""
    return _rolled(spark, sf_dir, {"words-1": None, "words-2": None})


def oracle() -> str:
    return r"""
WITH d AS (SELECT coalesce(text,'') AS text, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
c AS (SELECT source, lang, CASE WHEN lang = 'en' THEN 'words-2' ELSE 'words-1' END AS tokenizer_version,
  CASE WHEN lang = 'en' THEN len(regexp_extract_all(regexp_replace(text, '[!-/:-@\[-`{-~]', ' ', 'g'), '[^\x20\x09-\x0D]+')) + length(text) - length(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g'))
       ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS n FROM d)
SELECT source, lang, tokenizer_version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM c GROUP BY ALL"""
