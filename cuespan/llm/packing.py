"""Operator 5: packing documents into sequences by minimum bin slack.

Each document's token ids (and the closing id) are cut at multiples of the sequence
length: whole pieces are sequences of their own, the remainder has to be packed. For each
window the longest remaining remainder is fixed, a subset-sum dynamic programme over a
bitset finds the multiset of remaining lengths that comes closest to the capacity, and
the counts taken of each length are backtracked. The same multiset is then used as often
as the counts allow.

Remainders are packed inside groups of about ``GROUP_DOCS`` documents, dealt out by a hash
of the document: a task holds the lengths of its groups only, whatever the table's size,
and at most one sequence a group is left with more than trivial slack.

Defined edge cases: a null or empty text is the closing id alone; rows with one doc_id,
and repeated rows, are packed each on its own; a null doc_id stays null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import NO_ID, give_back, materialize, table

CAPACITY = 4096
END_ID = 2
GROUP_DOCS = 4096
CACHE_WORDS = 1_000_000
CHUNK_BYTES = 1 << 22
#: Marks after a run of letters are a unit of the vocabulary's rules; "'" may begin another.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCachedTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit numbers.

    The vocabulary's rules drop white space and never join characters across it, so a text's
    ids are those of its runs of anything but ASCII white space, and each such word is
    encoded once for a worker. Known words are an Arrow array, searched for all words of many
    texts at once; their ids lie in one array, from which those of the texts are gathered.
    Beyond ``cache_words`` words all are forgotten."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.encoder, self.limit = Tokenizer.from_file(path), cache_words
        self.ends = np.zeros(self.encoder.get_vocab_size(), bool)
        for token, i in self.encoder.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([""])  # what lies between two white spaces has no ids
        self.flat, self.size, self.start = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    @staticmethod
    def _gather(at: np.ndarray, ids: np.ndarray, size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words, one after another, and how many each has."""
        sizes = size[at]
        ends = np.cumsum(sizes)
        return ids[np.repeat(start[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def _encoded(self, words: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has; words of letters may be
        ``joined``: encoded many at a time, and parted after ids that end one."""
        groups = [words[i : i + 256] for i in range(0, len(words), 256)] if joined else [[w] for w in words]
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for group, e in zip(groups, self.encoder.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            x = np.array(e.ids, "<u4")
            n = np.array([len(x)])
            if len(group) > 1:
                cut = np.flatnonzero(self.ends[x]) + 1
                n = np.diff(cut, prepend=0)
                if len(cut) != len(group) or cut[-1] != len(x):  # not parted as expected: each on its own
                    x, n = self._encoded(group, False)
            ids.append(x)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, words: list[str]) -> pa.Array:
        """Encode new words; they are returned in the order in which they became known.

        Letters, and marks after them, are units of the vocabulary's rules."""
        letters, tails, others = [], [], []
        for w in words:
            if w.isalpha():
                letters.append(w)
                continue
            stem = w.rstrip(MARKS)
            # some letters become a letter and a mark, which goes with those after it
            if stem != w and stem.isalpha() and (stem.isascii() or unicodedata.normalize("NFC", stem).lower().isalpha()):
                tails.append((w, stem, w[len(stem) :]))
            else:
                others.append(w)
        units = {w: i for i, w in enumerate(dict.fromkeys([*letters, *(t[1] for t in tails)]))}
        marks = {w: i + len(units) for i, w in enumerate(dict.fromkeys(t[2] for t in tails))}
        (x, n), (y, m) = self._encoded(list(units), True), self._encoded([*marks, *others], False)
        ids, size = np.concatenate([x, y]), np.concatenate([n, m])
        start = np.cumsum(size) - size
        both, parts = self._gather(np.array([i for t in tails for i in (units[t[1]], marks[t[2]])], np.int64), ids, size, start)
        at = np.concatenate([np.arange(len(letters)), np.arange(len(units) + len(marks), len(size))])
        alone, n_alone = self._gather(at, ids, size, start)
        found = pa.array([*letters, *others, *(t[0] for t in tails)], pa.string())
        self.known = pa.concat_arrays([self.known, found])
        self.flat = np.concatenate([self.flat, alone, both])
        self.size = np.concatenate([self.size, n_alone, parts.reshape(-1, 2).sum(axis=1)])
        self.start = np.cumsum(self.size) - self.size
        return found

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and how many each has."""
        if len(self.known) > self.limit:
            self._forget()
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat, before = words.flatten(), len(self.known)
        at = pc.index_in(flat, value_set=self.known)
        gaps = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if len(gaps):
            missing = flat.take(pa.array(gaps))
            at[gaps] = before + pc.index_in(missing, value_set=self._learn(missing.unique().to_pylist())).to_numpy()
        ids, sizes = self._gather(at, self.flat, self.size, self.start)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])]
        return ids, np.diff(ends)


_TOKENIZERS: dict[str, WordCachedTokenizer] = {}


def _chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes, at least one text each."""
    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    first = 0
    while first < len(held):
        before = held[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(held, before + most, "right")))
        yield first, last
        first = last


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids; ``ids`` itself is kept on request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordCachedTokenizer(path)
        for b in batches:
            names, texts = b.column(0).to_numpy(), b.column(1)
            for first, last in _chunks(texts):
                ids, sizes = _TOKENIZERS[path].many(texts.slice(first, last - first))
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4", copy=False)  # the closing id after each text
                sizes = sizes + 1
                n = -(-sizes // capacity)
                which = np.repeat(np.arange(len(sizes)), n)
                start = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(sizes[which] - start, capacity)
                begin = (np.cumsum(sizes) - sizes)[which] + start
                raw = memoryview(ids).cast("B")
                parts = [raw[4 * a : 4 * z] for a, z in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                columns = [names[first:last][which], start, length, np.array([zlib.crc32(x) for x in parts], np.int64), sizes[which]]
                arrays = [pa.array(x, pa.int64()) for x in columns] + [pa.array([bytes(x) for x in parts], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)
        give_back()

    # null ids travel as a number: numpy would make floats of a column with nulls
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return rows.mapInArrow(run, PIECES + ", ids binary" * with_ids)


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset (length -> times) of available lengths whose sum is closest to, and at
    most, ``capacity``; among equal sums the longest lengths are preferred.

    ``reach`` has bit s set if some multiset of the lengths seen so far sums to s. Counts
    are split into powers of two, so a length costs a few shifts; the bitsets before each
    shift are kept for backtracking."""
    mask = (1 << (capacity + 1)) - 1
    reach, trail = 1, []
    for length in sorted(counts, reverse=True):
        if length > capacity:
            continue
        left, chunk = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(chunk, left)
            trail.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            chunk *= 2
        if reach >> capacity & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, take in reversed(trail):
        if not before >> at & 1:  # not reachable without this chunk
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def minimum_bin_slack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; items are taken in their order within a length."""
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    order = np.argsort(lengths, kind="stable")
    firsts = np.searchsorted(lengths[order], sorted(counts))
    queue = {length: int(at) for length, at in zip(sorted(counts), firsts, strict=True)}
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n_bins = 0
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        used = fill_window({k: v for k, v in rest.items() if v}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        for _ in range(min(counts[k] // v for k, v in used.items())):
            at = 0
            for length in sorted(used, reverse=True):
                for _ in range(used[length]):
                    item = order[queue[length]]
                    queue[length] += 1
                    bins[item], offsets[item] = n_bins, at
                    at += length
            n_bins += 1
            for k, v in used.items():
                counts[k] -= v
        counts = {k: v for k, v in counts.items() if v}
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    path = tokenizer_path or default_tokenizer_path()
    pieces = token_pieces(docs, path, capacity, with_ids=with_ids)
    # a unique number for each piece (ids may repeat), fixed by writing the pieces down
    pieces = materialize(pieces.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.filter(F.col("length") < capacity).count() // group_docs))
    full = pieces.filter(F.col("length") == capacity).select(*pieces.columns, (F.col("_piece") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).withColumn("_group", F.pmod(F.xxhash64("doc_id", "_piece"), F.lit(groups)))

    def assign(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_piece")
        bins, offsets = minimum_bin_slack(g["length"].to_numpy(), capacity)
        # odd numbers: apart from those of whole sequences
        seq = ((g["_group"].to_numpy(np.int64) << 31) + bins) * 2 + 1
        return pd.DataFrame({"_piece": g["_piece"].to_numpy(), "sequence_id": seq, "offset": offsets})

    if with_ids:  # only lengths go to the grouped tasks; ids join back
        placed = rest.select("_group", "_piece", "length").groupBy("_group").applyInPandas(assign, "_piece long, sequence_id long, offset long")
        packed = rest.drop("_group").join(placed, "_piece").select(*pieces.columns, "sequence_id", "offset")
    else:
        cols = [c for c in pieces.columns if c != "_piece"]

        def assign_all(g: pd.DataFrame) -> pd.DataFrame:
            return g.drop(columns="_group").merge(assign(g), on="_piece")[[*cols, "_piece", "sequence_id", "offset"]]

        packed = rest.groupBy("_group").applyInPandas(assign_all, f"{PIECES}, _piece long, sequence_id long, offset long")
    return full.unionByName(packed).drop("_piece").withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, padding (none where the length is a power of two)."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    bits = F.bit_count("n")
    return used.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(bits == 1, 0).otherwise(capacity - F.col("n"))).alias("padding"))


def op5_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
