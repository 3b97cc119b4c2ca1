"""Operator 12: removal of repeated byte strings, decided by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a smaller
doc_id, or earlier in the same document). Strings never cross documents, and all are judged
on the input.

Equal strings have to meet in one shard, and shards have to stay small:

1. Every string of ``length`` bytes has an anchor, the smallest hash of its ``GRAM``-byte
   grams. Neighbouring strings with one anchor make a segment (some 40 strings, 140 bytes),
   and equal strings lie in segments of one anchor, wherever they are. Anchors are counted,
   with a digest of their segments, as packed arrays; a bitmap says which segments occur twice,
   another which anchors have different segments. A string reaches beyond its anchor by half of
   the rest on one side at least, so of different segments only those can share a string whose
   anchors are equal with that much before them, or after them: these keys are counted
   likewise, and the other segments go no further. (A bitmap has 16 MB at most: false hits
   cost, and change nothing.)
2. Of segments that are equal as a whole the first one stays, the rest repeat it. What is
   left, the different segments of one anchor, goes to shards by anchor.
3. A shard gets a suffix array by induced sorting: suffixes are classified, leftmost smaller
   ones (LMS) sorted by their substrings, recursively by pairs of names while names are
   equal, and the rest induced, bucket by bucket, in linear time. The permuted common
   prefixes are compared only where the letter before differs; the others follow from these.
   Strings with a common prefix of ``length`` are equal, and all but the first are repeats.
4. An anchor with more segments than fit a shard is taken apart into its single strings,
   which meet by 128 bits of hash in an ordinary aggregate: no group has to fit a task.

Defined edge cases: a null text is empty; texts shorter than ``length`` lose nothing; rows
with one doc_id are ordered by a hash of their texts, and rows equal in id and text are one
document and are treated alike; a null doc_id comes after all others; an empty table gives
an empty result; other columns are ignored. What is kept is bytes: a cut may fall inside a
character.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import HOT_KEYS, NO_ID, give_back, hot_join, materialize, scratch_path, table

LENGTH = 100
GRAM = 24
CHUNK = 1 << 20  # bytes of a batch that are hashed at a time
SHARD_BYTES = 1 << 21
MAX_FILTER_BITS = 27  # 16 MB at most, for each of the two bitmaps
BUCKET_HASHES = 2_000_000  # a task sorts so many at a time
MAX_BUCKETS = 1 << 20
_BASE = 0x9E3779B97F4A7C15
SEPARATOR = 255  # no byte of UTF-8
_powers: dict[int, np.ndarray] = {}

# --- anchors ---------------------------------------------------------------------------


def gram_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position on, by doubling."""
    h, size, out, done = text.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, done = h, size
            else:
                m = min(len(out), len(h) - done)
                out = out[:m] * np.uint64(pow(_BASE, size, 1 << 64)) + h[done : done + m]
                done += size
        if 2 * size > k:
            break
        h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(32))


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over w neighbours, by doubling."""
    size = 1
    while 2 * size <= w:
        x, size = f(x[:-size], x[size:]), 2 * size
    return f(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def chunk_segments(raw: np.ndarray, off: np.ndarray, lo: int, hi: int, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Segments among the strings that start in raw[lo:hi]: start, number of strings, anchor,
    whether the anchor's hash is in the segment twice, and where it is (first). ``off``: where
    documents begin."""
    w = length - k + 1
    text = raw[lo : min(hi + length - 1, int(off[-1]))]
    if len(text) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, bool, np.int64))
    g = gram_hashes(text, k)
    v = sliding(g, w, np.minimum)
    edges = off[np.searchsorted(off, lo, "right") : np.searchsorted(off, lo + len(v), "left")] - lo  # of documents, inside
    ok = np.ones(len(v), bool)
    for e in edges.tolist():
        ok[max(0, e - length + 1) : e] = False
    last = off[min(np.searchsorted(off, lo + len(v), "left"), len(off) - 1)] - lo  # the end of the last one
    ok[max(0, last - length + 1) :] = False
    new = ok.copy()
    new[1:] &= (v[1:] != v[:-1]) | ~ok[:-1]
    new[edges[edges < len(v)]] |= ok[edges[edges < len(v)]]
    stops = np.flatnonzero(new | ~ok)
    begins = np.flatnonzero(new[stops])
    start = stops[begins]
    n = np.append(stops, len(v))[begins + 1] - start
    parts = -(-n // w)  # runs of one hash that comes again and again are cut
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start, n = np.repeat(start, parts) + nth * w, np.minimum(np.repeat(n, parts) - nth * w, w)
    padded = np.zeros(len(v) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(v)] = v
    at = np.flatnonzero(g == sliding(padded, w, np.maximum))  # where the anchors are
    a, z = np.searchsorted(at, start), np.searchsorted(at, start + n + w - 1)
    size = z - a  # one at least
    spot = at[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    mine = g[spot] == np.repeat(v[start], size)
    spot = np.minimum.reduceat(np.where(mine, spot, len(g)), np.cumsum(size) - size) if len(start) else np.zeros(0, np.int64)
    twice = np.add.reduceat(mine, np.cumsum(size) - size, dtype=np.int64) > 1 if len(start) else np.zeros(0, bool)
    # the smallest of many hashes are small numbers: mixed again, they fill the range
    anchor = (v[start] ^ (v[start] >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return start + lo, n, anchor ^ (anchor >> np.uint64(32)), twice, spot + lo


def powers_of(base: int, n: int) -> np.ndarray:
    """base to the power of 0 to n - 1, and some more: one table for all stretches."""
    if len(_powers.get(base, ())) < n:
        x = np.full(max(n, 1 << 21), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x, dtype=np.uint64)
    return _powers[base]


def segment_digests(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of the bytes of each segment: a polynomial, from running sums of a stretch."""
    out = np.zeros(len(start), np.uint64)
    cuts = np.flatnonzero(np.diff(start >> 20)) + 1  # of a MB, however few there are in it
    for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(start)], strict=True):
        if at == end:
            continue
        s, m = start[at:end], size[at:end]
        lo, hi = int(s.min()), int((s + m).max())
        powers, back = powers_of(_BASE, hi - lo), powers_of(pow(_BASE, -1, 1 << 64), hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * powers[: hi - lo], out=sums[1:])
        x = (sums[s + m - lo] - sums[s - lo]) * back[s - lo]
        x = (x ^ (x >> np.uint64(32)) ^ m.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out[at:end] = x ^ (x >> np.uint64(32))
    return out


def batch_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, one text after the other, and their offsets."""
    _, offsets, values = texts.buffers()
    off = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(values, np.uint8)[: int(off[-1])] if values is not None else np.zeros(0, np.uint8)
    return raw, off


def batch_segments(raw: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Start, number of strings, anchor, digest, ``twice`` and the anchor's place of all segments
    of a batch. The last bit of a digest is ``twice``, which a segment's bytes decide."""
    found = [chunk_segments(raw, off, lo, min(lo + CHUNK, int(off[-1])), length, k) for lo in range(int(off[0]), int(off[-1]), CHUNK)]
    if not found:
        found = [chunk_segments(raw, off, 0, 0, length, k)]
    start, n, anchor, twice, spot = (np.concatenate(x) for x in zip(*found, strict=True))
    digest = segment_digests(raw, start, n + length - 1) & ~np.uint64(1) | twice.astype(np.uint64)
    return start, n, anchor, digest, twice, spot


def side_keys(raw: np.ndarray, start: np.ndarray, n: np.ndarray, spot: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Keys of the anchors' left and right neighbourhoods, and in which segments they are whole.

    A string of ``length`` bytes has its anchor and, besides, half of the rest before it or half
    of it after it. So equal strings, where no anchor is in a segment twice, lie in segments
    of which a left or a right key is the same."""
    half = (length - k) // 2
    left, right = start <= spot - half, start + n - 1 >= spot - (length - k - half)
    keys = []
    for has, begin, salt in ((left, spot - half, _BASE), (right, spot, 0xD6E8FEB86659FD93)):
        out = np.zeros(len(start), np.uint64)
        some = np.flatnonzero(has)
        if len(some):
            x = (segment_digests(raw, begin[some], np.full(len(some), k + half)) ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
            out[some] = x ^ (x >> np.uint64(29))
        keys.append(out)
    return left, keys[0], right, keys[1]


def _bits_of(buckets: int) -> int:
    return buckets.bit_length() - 1


def pair_index(anchor: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """What a segment has in its anchor's bucket: mixed, with the anchor's first bits."""
    x = (anchor ^ (digest >> np.uint64(1)) * np.uint64(_BASE)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    top = np.uint64(_bits_of(MAX_BUCKETS))
    return (anchor >> (np.uint64(64) - top) << (np.uint64(64) - top)) | (x >> top)


def hit_of(bits: int):
    """Says which hashes have their bit set in a bitmap of 2^bits."""

    def hit(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        index = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        return (bitmap[index >> 3] >> (index & 7).astype(np.uint8)) & 1 == 1

    return hit


class Maps:
    """Bitmaps of 2^bits bits at most that say of hashes what ``counted`` found."""

    def __init__(self, rows: DataFrame, total: int) -> None:
        self.rows, self.total = rows, total
        self.bits = min(MAX_FILTER_BITS, max(16, int(total / 8).bit_length()))
        self.buckets = 1 << min(_bits_of(MAX_BUCKETS), self.bits - 3, max(6, math.ceil(math.log2(max(1, total / 30 / BUCKET_HASHES)))))

    def counted(self, entries, found, n: int) -> list[np.ndarray]:
        """``entries`` makes (key, value) rows of a batch, sorted; ``found`` gives, of all of a
        bucket, sorted as well, n arrays of hashes, each of which sets bits of one bitmap."""
        bits, buckets, own = self.bits, self.buckets, self.bits - _bits_of(self.buckets)
        shift = np.uint64(64 - _bits_of(buckets))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                both = entries(*batch_bytes(b.column("raw")))
                both = both[np.lexsort((both[:, 1], both[:, 0]))]
                third = np.zeros(len(both), bool)  # two of a kind say all: a hot key stays small
                third[2:] = (both[2:] == both[:-2]).all(1)
                both = both[~third]
                bucket = (both[:, 0] >> shift).astype(np.int64)
                names, first = np.unique(bucket, return_index=True)
                parts = np.split(both, first[1:]) if len(names) else []
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["bucket", "packed"])
            give_back()

        def count(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            both = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 2) for x in part["packed"]])
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            out = []
            for hashes in found(both):
                mask = np.zeros(1 << own, np.uint8)
                mask[((hashes >> np.uint64(64 - bits)) & np.uint64((1 << own) - 1)).astype(np.int64)] = 1
                out.append(np.packbits(mask, bitorder="little").tobytes())
            return pd.DataFrame({"bucket": [key[0]], "maps": [out]})

        counted = self.rows.select("raw").mapInArrow(pack, "bucket int, packed binary").groupBy("bucket").applyInPandas(count, "bucket int, maps array<binary>")
        maps = np.zeros((n, buckets, (1 << own) // 8), np.uint8)
        for r in counted.collect():  # 16 MB a bitmap, at most
            for i, x in enumerate(r.maps):
                maps[i, r.bucket] = np.frombuffer(x, np.uint8)
        return [x.ravel() for x in maps]


def _needed(raw: np.ndarray, found: tuple[np.ndarray, ...], hit, maps: tuple[np.ndarray, ...], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of segments: which have an anchor with different ones, which of these have an anchor that
    is in one of them twice, and the side keys of the others."""
    start, n, anchor, _, twice, spot = found
    apart = hit(maps[0], anchor) | twice
    wild = apart & (hit(maps[2], anchor) | twice)
    some = np.flatnonzero(apart & ~wild)
    return apart, wild, some, side_keys(raw, start[some], n[some], spot[some], length, k)


def bitmaps(rows: DataFrame, length: int, k: int) -> tuple[Maps, tuple[np.ndarray, ...]]:
    """Bitmaps of: anchors that have two different segments, segments that occur twice, anchors
    that are twice in one segment, and side keys that two different segments have."""
    total = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    maps = Maps(rows, total)

    def anchors(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        _, _, anchor, digest, _, _ = batch_segments(raw, off, length, k)
        return np.stack([anchor, digest], 1)

    def kinds(both: np.ndarray) -> list[np.ndarray]:
        anchor, digest = both[:, 0], both[:, 1]
        same = anchor[1:] == anchor[:-1]
        equal = same & (digest[1:] == digest[:-1])
        return [anchor[1:][same & ~equal], pair_index(anchor[1:][equal], digest[1:][equal]), anchor[digest & np.uint64(1) == 1]]

    apart, equal, wild = maps.counted(anchors, kinds, 3)
    hit, shared = hit_of(maps.bits), rows.sparkSession.sparkContext.broadcast((apart, equal, wild))

    def sides(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        found = batch_segments(raw, off, length, k)
        _, _, some, (left, a, right, b) = _needed(raw, found, hit, shared.value, length, k)
        digest = found[3][some]
        return np.concatenate([np.stack([a[left], digest[left]], 1), np.stack([b[right], digest[right]], 1)])

    def different(both: np.ndarray) -> list[np.ndarray]:
        return [both[1:, 0][(both[1:, 0] == both[:-1, 0]) & (both[1:, 1] != both[:-1, 1])]]

    return maps, (apart, equal, wild, *maps.counted(sides, different, 1))


def segment_rows(rows: DataFrame, length: int, k: int) -> DataFrame:
    """The segments that occur twice or may share a string with a different one: id, h, start,
    n, anchor, digest, and for the latter their bytes. Segments that come again in their own
    document have no anchor: all their strings are repeats."""
    maps, found_maps = bitmaps(rows, length, k)
    hit, shared = hit_of(maps.bits), rows.sparkSession.sparkContext.broadcast(found_maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = batch_bytes(b.column("raw"))
            found = batch_segments(raw, off, length, k)
            _, apart, some, (left, x, right, y) = _needed(raw, found, hit, shared.value, length, k)
            apart[some] = left & hit(shared.value[3], x) | right & hit(shared.value[3], y)
            start, n, anchor, digest, _, _ = found
            some = np.flatnonzero(apart | hit(shared.value[1], pair_index(anchor, digest)))
            start, n, anchor, digest, apart = (x[some] for x in (start, n, anchor, digest, apart))
            doc = np.searchsorted(off, start, "right") - 1
            # the same segment again, in the same document
            by = np.lexsort((start, digest, anchor, doc))
            again = np.zeros(len(by), bool)
            again[by[1:]] = (doc[by[1:]] == doc[by[:-1]]) & (anchor[by[1:]] == anchor[by[:-1]]) & (digest[by[1:]] == digest[by[:-1]])
            shown = apart & ~again
            size = np.where(shown, n + length - 1, 0)
            ends = np.cumsum(size)
            flat = raw[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            at = np.concatenate([[0], ends]).astype(np.int32)
            null = pa.py_buffer(np.packbits(shown, bitorder="little").tobytes())
            segments = pa.Array.from_buffers(pa.binary(), len(some), [null, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.tobytes())])
            take = lambda c: b.column(c).take(pa.array(doc))
            long = lambda x: pa.array(x.view(np.int64), mask=again)
            yield pa.RecordBatch.from_arrays(
                [take("id"), take("h"), pa.array(start - off[doc]), pa.array(n.astype(np.int32)), long(anchor), long(digest), segments],
                names=["id", "h", "start", "n", "anchor", "digest", "seg"],
            )
        give_back()

    return rows.mapInArrow(run, "id long, h long, start long, n int, anchor long, digest long, seg binary")


# --- suffix arrays ---------------------------------------------------------------------


def _place(sa: np.ndarray, at: np.ndarray, chars: np.ndarray, which: np.ndarray, step: int) -> None:
    """Put ``which`` where its letters' pointers ``at`` are, in order, and move these by ``step``."""
    by = np.argsort(chars, kind="stable")
    c = chars[by]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    count = np.diff(np.append(first, len(c)))
    nth = np.arange(len(c)) - np.repeat(first, count)
    sa[at[c] + step * nth] = which[by]
    at[c[first]] += step * count


def induced(text: np.ndarray, is_s: np.ndarray, bounds: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from ``lms``, the LMS suffixes in theirs. ``text`` ends with its
    only 0; bounds[c] is where the suffixes that begin with c begin."""
    sa = np.full(len(text), -1, np.int64)
    tails = bounds[1:] - 1
    _place(sa, tails, text[lms[::-1]], lms[::-1], -1)
    seeds, heads = tails + 1, bounds[:-1].copy()
    letters = np.flatnonzero(np.diff(bounds))

    def step(block: np.ndarray, at: np.ndarray, small: bool, way: int) -> None:
        before = block[block > 0] - 1
        before = before[is_s[before] == small]
        if len(before):
            _place(sa, at, text[before], before, way)

    for c in letters.tolist():  # larger suffixes, from the left
        lo = bounds[c]
        while lo < heads[c]:
            hi = heads[c]
            step(sa[lo:hi], heads, False, 1)
            lo = hi
        step(sa[seeds[c] : bounds[c + 1]], heads, False, 1)
    tails = bounds[1:] - 1
    for c in letters[::-1].tolist():  # smaller ones, from the right
        if not c:
            break
        hi = bounds[c + 1] - 1
        while hi > tails[c]:
            lo = tails[c]
            step(sa[lo + 1 : hi + 1][::-1], tails, True, -1)
            hi = lo
        step(sa[bounds[c] : heads[c]][::-1], tails, True, -1)
    return sa


def sorted_names(rank: np.ndarray, some: np.ndarray | None = None, size: int = 1) -> np.ndarray:
    """The place of each suffix of a string of names. ``rank`` sorts them by their first
    ``size`` names, equal ones (``some``) by the place of the first of them: two halves make
    the next ranks, of these alone."""
    if some is None:
        some = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)
    if not len(some):
        return rank
    ahead = some + size
    half = np.where(ahead < len(rank), rank[np.minimum(ahead, len(rank) - 1)] + 1, 0)
    pair = rank[some] * (len(rank) + 1) + half
    by = np.argsort(pair)
    some, pair = some[by], pair[by]
    a = pair // (len(rank) + 1)
    place = np.arange(len(some))
    fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
    group = np.concatenate([[True], a[1:] != a[:-1]])
    rank = rank.copy()
    rank[some] = a + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
    alone = fresh & np.append(fresh[1:], True)
    return sorted_names(rank, some[~alone], 2 * size)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of an array of bytes in order, by induced sorting."""
    n = len(data)
    text = np.zeros(n + 1, np.int16)
    text[:n] = data.astype(np.int16) + 1
    same = np.append(text[:-1] == text[1:], False)
    ahead = np.minimum.accumulate(np.where(same, n, np.arange(n + 1))[::-1])[::-1]  # where the run of a letter ends
    is_s = np.append(text[:-1] < text[1:], True)[ahead]
    marks = np.zeros(n + 1, bool)
    marks[1:] = is_s[1:] & ~is_s[:-1]
    lms = np.flatnonzero(marks)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=257))])
    # LMS suffixes in any order of one letter induce the order of the LMS substrings
    rough = induced(text, is_s, bounds, lms[np.argsort(text[lms], kind="stable")])
    rough = rough[marks[rough]]
    size = np.ones(n + 1, np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    a, b = rough[:-1], rough[1:]
    equal = size[a] == size[b]
    where = np.flatnonzero(equal)
    if len(where):
        m = size[a[where]]
        begin = np.cumsum(m) - m
        flat = np.arange(m.sum()) - np.repeat(begin, m)
        equal[where] = np.logical_and.reduceat(text[np.repeat(a[where], m) + flat] == text[np.repeat(b[where], m) + flat], begin)
    rank = np.zeros(n + 1, np.int64)  # equal substrings have the place of the first of them
    rank[rough] = np.maximum.accumulate(np.where(np.concatenate([[True], ~equal]), np.arange(len(rough)), 0))
    order = np.zeros(len(lms), np.int64)
    order[sorted_names(rank[lms])] = lms
    return induced(text, is_s, bounds, order)


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, heads: np.ndarray, cap: int) -> np.ndarray:
    """For each position the common prefix with the suffix before it in ``sa``, in the order of
    the text, exact up to ``cap`` at ``heads`` and where the letter before differs; from there
    it falls by one a position."""
    n = len(data)
    before = np.zeros(n + 1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    prev = before[:n]
    free = heads | (at == 0) | (prev == 0) | (data[at - 1] != data[prev - 1])
    padded = np.zeros(n + cap + 16, np.uint8)
    padded[:n] = data
    words = np.ndarray((n + cap + 8,), "<u8", padded, strides=(1,))
    i = np.flatnonzero(free)
    j, common, live = prev[i], np.zeros(len(i), np.int64), np.arange(len(i))
    for k in range(0, cap + 8, 8):
        x = words[i[live] + k] ^ words[np.minimum(j[live], n) + k]
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        common[live[differ]] = k + np.bitwise_count(low - np.uint64(1)) // 8
        live = live[~differ]
        if not len(live):
            break
    common[live] = cap + 8
    common = np.minimum(common, n - np.maximum(i, j))
    nth = np.cumsum(free) - 1
    return common[nth] - (at - i[nth])


def shard_repeats(segments: list[bytes], order: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings of ``length`` bytes that are in an earlier place as well: index of the
    segment, first string and number. ``order`` is that of the segments' documents."""
    size = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(bytes([SEPARATOR]).join(segments), np.uint8)
    first = np.cumsum(size + 1) - size - 1
    sa = suffix_array(data)
    which = np.repeat(np.arange(len(size)), size + 1)[: len(data)]
    inner = np.arange(len(data)) - first[which]
    valid = inner + length <= size[which]
    prefix = permuted_prefixes(data, sa, inner == 0, int(size.max()))
    place = np.full(len(data) + 1, np.iinfo(np.int64).max)
    # documents first, then the place in them; a shard has fewer than 2^22 documents
    place[:-1][valid] = (order[which[valid]] << 41) + start[which[valid]] + inner[valid]
    equal = np.zeros(len(sa), bool)
    real = sa[1:]
    equal[1:] = valid[real] & (prefix[real] >= length)
    runs = np.flatnonzero(~equal)
    least = np.minimum.reduceat(place[sa], runs)
    late = np.zeros(len(data) + 1, bool)
    late[sa] = place[sa] != np.repeat(least, np.diff(np.append(runs, len(sa))))
    late = late[:-1] & valid
    edge = np.flatnonzero(late & ~np.concatenate([[False], late[:-1]]))
    end = np.flatnonzero(late & ~np.concatenate([late[1:], [False]]))
    return which[edge], inner[edge], end - edge + 1  # separators are never late, so no run leaves its segment


# --- the operator ----------------------------------------------------------------------

_SPAN = "id long, h long, start long, n long"


def _document(docs: DataFrame) -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("raw")]


def _by_strings(large: DataFrame, length: int) -> DataFrame:
    """Repeats in anchors that don't fit a shard: single strings, by 128 bits of hash."""
    one = F.explode(F.transform(F.sequence(F.lit(0), F.length("seg") - length), lambda i: F.struct(i.alias("i"), F.substring(F.col("seg"), i + 1, F.lit(length)).alias("s")))).alias("x")
    rows = large.select("id", "h", F.col("start").alias("from"), "anchor", one)
    rows = rows.select("id", "h", (F.col("from") + F.col("x.i")).alias("start"), "anchor", F.xxhash64("x.s").alias("a"), F.xxhash64(F.lit("second"), "x.s").alias("b"))
    rows = materialize(rows, "suffix-strings")
    first = rows.groupBy("anchor", "a", "b").agg(F.min(F.struct("id", "h", "start")).alias("first"), F.count("*").alias("m")).filter("m > 1")
    total = rows.count()
    late = hot_join(rows, materialize(first, "suffix-first"), ["anchor", "a", "b"], F.col("m") * HOT_KEYS > total).filter(F.struct("id", "h", "start") != F.col("first"))
    return late.select("id", "h", "start", F.lit(1).cast("long").alias("n"))


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, h, start, n): runs of n strings, from byte ``start`` on, that also start earlier."""
    spark = docs.sparkSession
    path = scratch_path(spark, "suffix-segments")
    found = segment_rows(docs.select(*_document(docs)), length, gram)
    found.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(found.schema).parquet(path)
    key = ["anchor", "digest"]
    kinds = rows.filter("anchor is not null").groupBy(*key).agg(F.min(F.struct("id", "h", "start")).alias("first"), F.count("*").alias("m"), F.max("seg").alias("seg"))
    kinds = materialize(kinds.filter("m > 1 or seg is not null"), "suffix-kinds")
    again = rows.filter("anchor is null").select("id", "h", "start", F.col("n").cast("long").alias("n"))
    total = rows.count()
    whole = hot_join(rows.select("id", "h", "start", "n", *key), kinds.filter("m > 1").select(*key, "first", "m"), key, F.col("m") * HOT_KEYS > total)
    whole = whole.filter(F.struct("id", "h", "start") != F.col("first")).select("id", "h", "start", F.col("n").cast("long").alias("n"))
    segments = kinds.filter("seg is not null").select("anchor", "first.*", "seg")
    sizes = materialize(segments.groupBy("anchor").agg(F.sum(F.length("seg")).alias("bytes")), "suffix-anchors")
    large = sizes.filter(F.col("bytes") > shard_bytes // 2)
    r = sizes.agg(F.sum(F.when(F.col("bytes") <= shard_bytes // 2, F.col("bytes"))).alias("b"), F.max("bytes").alias("most")).first()
    shards = max(1, -(-(r.b or 0) // shard_bytes))
    some = segments.join(large, "anchor", "left_anti") if (r.most or 0) > shard_bytes // 2 else segments

    def sort_shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "h", "start"], ignore_index=True)
        document = (part[["id", "h"]] != part[["id", "h"]].shift()).any(axis=1).cumsum().to_numpy(np.int64)
        which, inner, n = shard_repeats(part["seg"].tolist(), document, part["start"].to_numpy(), length)
        out = part[["id", "h", "start"]].iloc[which]
        return out.assign(start=out["start"] + inner, n=n)

    late = some.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInPandas(lambda part: sort_shard(part), _SPAN)
    out = again.unionByName(whole).unionByName(late)
    if (r.most or 0) > shard_bytes // 2:
        out = out.unionByName(_by_strings(segments.join(large.select("anchor"), "anchor"), length))
    return out


def dedup_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, ``kept`` (bytes), and ``spans``: start and size of what was removed."""
    late = repeated_strings(docs, length, gram, shard_bytes)
    runs = late.groupBy("id", "h").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    both = docs.select("doc_id", *_document(docs)).join(runs, ["id", "h"], "left").select("doc_id", "raw", F.col("runs.start").alias("starts"), F.col("runs.n").alias("ns"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, spans = [], []
            for raw, starts, ns in zip(b.column("raw"), b.column("starts"), b.column("ns"), strict=True):
                raw = raw.as_buffer() if raw.is_valid else b""
                if not starts.is_valid:
                    kept.append(raw)
                    spans.append([])
                    continue
                s, n = starts.values.to_numpy(), ns.values.to_numpy()
                by = np.argsort(s, kind="stable")
                s, reach = s[by], np.maximum.accumulate((s + n)[by] + length - 1)
                first = np.concatenate([[True], s[1:] > reach[:-1]])
                lo, hi = s[first], reach[np.concatenate([first[1:], [True]])]
                view = memoryview(raw)
                kept.append(b"".join([view[a:z] for a, z in zip([0, *hi.tolist()], [*lo.tolist(), len(view)], strict=True)]))
                spans.append([{"start": a, "size": z - a} for a, z in zip(lo.tolist(), hi.tolist(), strict=True)])
            raws = b.column("raw")
            n_bytes = [x.as_buffer().size if x.is_valid else 0 for x in raws]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array([bytes(x) for x in kept], pa.binary()), pa.array(spans, kind)], names=["doc_id", "n_bytes", "kept", "spans"])
        give_back()

    return both.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, kept binary, spans array<struct<start: long, size: long>>")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_strings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col("n_bytes") - F.length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def oracle(length: int = LENGTH) -> str:
    """DuckDB SQL of op12: every string of ``length`` bytes, as hexadecimal text."""
    return f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, {2 * length}) AS s FROM (SELECT doc_id, x, unnest(range(0, n - {length - 1})) AS p FROM t WHERE n >= {length})),
m AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
g AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {length} THEN 0 ELSE 1 END AS opens FROM m)),
r AS (SELECT doc_id, min(p) AS lo, max(p) + {length} AS hi FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(hi) AS last, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept
  FROM (SELECT r.*, x, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM r JOIN t USING (doc_id)) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)"""
