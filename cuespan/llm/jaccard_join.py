"""Operator 6: exact n-gram Jaccard self-join by T-occurrence search (DivideSkip).

Two documents link when their sets of distinct word shingles have a Jaccard similarity of
at least num/den. A linked partner of a document with n shingles shares at least
T = ceil(num * n / den) of them, so it occurs T times or more in the document's n inverted
lists. The longest L lists are set aside, the short ones are merged with a heap that skips
ahead (candidates occur T - L times there), and the long ones are only binary-probed for
these candidates.

How it is spread out, without cross joins, pairs inside groups, or sampled counts:

1. Equal sets collapse to one class (a 64-bit digest of the set).
2. Inverted lists are only shuffled where they can be short lists. Of each set, the
   e + m smallest hashes form its window (e = n - T: what a partner may lack;
   m = ceil(n / 4)); windows of partners share at least ceil(T / 4) hashes. All windows'
   hashes are counted over all documents, and the rarest |window| - ceil(T / 4) + 1 are
   the document's short lists: partners meet in at least one. Hashes found in one class
   only are dropped, and with them almost every document without a partner. A hash that is
   frequent already inside one batch of input is kept out of the shuffle (it is counted
   there, and ordered last), so no hot list reaches one task.
3. Partners' sizes differ by a factor of den / num at most, so classes are dealt to size
   bands that overlap: a class is in two, partners share one, and a passage that texts of all
   lengths have doesn't make one component of them. Inside a band, lists are joined to stars
   around their smallest class, whose connected components hold every possible link. Hot
   lists are nodes of that graph themselves: a task contracts the ones of the classes it reads
   to a spanning forest, so that a group of near copies costs about one edge a class,
   whatever the number of hashes that all of them have. Components whose pairs all meet in
   the next band too are left to it, and those of one class to nobody. The others are dealt
   into blocks of bounded size; one too large for a block is cut into chunks, and each pair
   of chunks is a block.
4. Inside a block the T-occurrence search runs over the full sets: short lists are merged, as
   arrays where they are many, and long ones probed for all candidates at once, or read once
   where that is less. Two classes already connected are not searched again: the result is
   components, not all pairs.
   ``link_counts`` searches these as well, and counts every link.

Defined edge cases: null and empty texts, and those of white space, have an empty set and
link with nothing; texts with fewer words than a shingle are one shingle; rows with one
doc_id are judged by their texts; a null doc_id orders last, and its component is that of
its class if some other row is in it, else null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import HOT_KEYS, NO_ID, give_back, hot_join, materialize, table
from .components import connected_components, spanning_stars

SHINGLE = 4
NUM, DEN = 85, 100
LOCAL_HOT = 64
BLOCK_TOKENS = 500_000
MAX_SET = 1 << 48  # shingles of a set: the last band begins below
MU = 0.0085  # cost of a probe against a merge step, as published for DivideSkip
FEW = 64  # postings that are merged one by one
PROBE = 8  # cost of a binary probe against a posting that is read
MAX_FILTER_BITS = 27  # 16 MB at most
MIN_BUCKETS, BUCKET_TOKENS = 64, 3_000_000  # of the hash range, in which windows are counted
MAX_BUCKETS = 16_384  # beyond that buckets grow, and their sort spills: arrays stay long
_CACHE_WORDS = 200_000
_BATCH_DOCS = 2000  # of an input batch at a time: bounds what a task holds
_HOT_RANK = 1 << 62
_words: dict[bytes, int] = {}


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > _CACHE_WORDS:
        _words.clear()
    for w in words:
        if w not in _words:
            _words[w] = xxhash.xxh64_intdigest(w)
    h = np.array([_words[w] for w in words], dtype=np.uint64)
    k = min(size, len(h))
    x = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        x = (x ^ h[i : i + len(x)]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return np.unique(x)


def set_digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def need(n: int, num: int, den: int) -> int:
    """T: how many of its n shingles a document shares with a partner, at least."""
    return -(-num * n // den)


def band_starts(num: int, den: int) -> list[int]:
    """Where bands of set sizes begin: a partner of a set in one is in it or a neighbour."""
    out = [1]
    while out[-1] < MAX_SET:
        out.append(max(out[-1] + 1, -(-out[-1] * den // num)))
    return out


def in_bands(lists: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """A row of ``lists`` (sid, n, ...) for each of the two bands of its size, with ``own``, the
    number of the band that begins below n, and ``node``, which stands for (sid, band)."""
    own = F.size(F.filter(F.array(*[F.lit(x) for x in band_starts(num, den)]), lambda x: x <= F.col("n")))
    rows = lists.withColumn("own", own).withColumn("band", F.explode(F.array(F.col("own") - 1, F.col("own"))))
    return rows.withColumn("node", F.xxhash64("sid", "band"))


def merge_skip(lists: list[list[int]], times: int) -> Iterator[tuple[int, int]]:
    """Ids found in at least ``times`` of the sorted lists, ascending, with their counts.
    Where fewer lists agree, ``times`` - 1 lists jump ahead to the next possible id."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= times:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= times:
            yield top, len(popped)
            for _, i, at in popped:
                if at + 1 < len(lists[i]):
                    heapq.heappush(heap, (lists[i][at + 1], i, at + 1))
            continue
        while heap and len(popped) < times - 1:
            popped.append(heapq.heappop(heap))
        if not heap:
            return
        nxt = heap[0][0]
        for _, i, at in popped:
            at = bisect_left(lists[i], nxt, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))


def link_block(sets: list[np.ndarray], num: int = NUM, den: int = DEN, every: bool = False) -> list[tuple[int, int]]:
    """Links that span the components of the sets (positions in ``sets``); with ``every``
    all links, those inside a component as well."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order])
    n_docs = len(order)
    if n_docs < 2:
        return []
    doc = np.repeat(np.arange(n_docs), size)
    token = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    by = np.lexsort((doc, token))
    posting = doc[by]
    start = np.concatenate([[0], np.cumsum(np.bincount(token))])
    rank = np.empty(len(doc), np.int64)  # how many smaller documents are in the list
    rank[by] = np.arange(len(doc)) - start[token[by]]
    first = np.concatenate([[0], np.cumsum(size)])
    entry = token[by] * n_docs + posting  # all lists, each sorted, one after another
    label, links = np.arange(n_docs), []
    for q in range(n_docs):
        mine, before = token[first[q] : first[q + 1]], rank[first[q] : first[q + 1]]
        t = need(int(size[q]), num, den)
        live = np.flatnonzero(before)
        if len(live) < t:
            continue
        live = live[np.argsort(-before[live], kind="stable")]
        longest = int(before[live[0]])
        n_long = min(t - 1, int(t / (MU * math.log2(longest) + 1)) if longest > 1 else t - 1)
        long_lists, short = live[:n_long], live[n_long:]
        low = int(np.searchsorted(size, t))  # smaller sets can't share t
        spans = [posting[start[x] : start[x] + n] for x, n in zip(mine[short], before[short], strict=True)]
        if int(before[short].sum()) <= FEW:
            merged = list(merge_skip([s[s >= low].tolist() for s in spans], t - n_long))
            ids, count = (np.array([x[i] for x in merged], np.int64) for i in (0, 1))
        else:  # the same merge, of whole arrays
            count = np.bincount(np.concatenate(spans))
            ids = np.flatnonzero(count >= t - n_long)
            ids = ids[ids >= low]
            count = count[ids]

        def other(ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            apart = label[ids] != label[q]  # connected already: not looked at again
            return ids[apart], count[apart]

        def linked(ids: np.ndarray, count: np.ndarray) -> np.ndarray:
            tokens = mine[long_lists]
            if len(ids) * n_long * PROBE <= int(before[long_lists].sum()):
                wanted = np.sort(tokens) * n_docs + ids[:, None]  # binary probes of the long lists
                at = np.minimum(np.searchsorted(entry, wanted.ravel()), len(entry) - 1)
                both = count + (entry[at].reshape(wanted.shape) == wanted).sum(1)
            elif n_long:  # as many candidates as that: each long list is read once
                every_long = np.concatenate([posting[start[x] : start[x] + n] for x, n in zip(tokens, before[long_lists], strict=True)])
                both = count + np.bincount(every_long, minlength=q)[ids]
            else:
                both = count
            return den * both >= num * (size[q] + size[ids] - both)

        if every:
            links += [(order[q], order[r]) for r in ids[linked(ids, count)].tolist()]
            continue
        ids, count = other(ids, count)
        while len(ids):  # the likeliest alone: where it links, all that it is connected to is settled
            best = int(count.argmax())
            if not linked(ids[best : best + 1], count[best : best + 1])[0]:
                ids, count = np.delete(ids, best), np.delete(count, best)
                break
            links.append((order[q], order[ids[best]]))
            label[label == label[ids[best]]] = label[q]
            ids, count = other(ids, count)
        for r in ids[linked(ids, count)].tolist() if len(ids) else []:
            if label[r] != label[q]:
                links.append((order[q], order[r]))
                label[label == label[r]] = label[q]
    return links


def window_rows(docs: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN, local_hot: int = LOCAL_HOT) -> DataFrame:
    """One row a document: id, class ``sid`` (null for an empty set), n, and, for the first
    row of its class in a task, its window's hashes; one row more for each batch's hot hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in (whole.iloc[at : at + _BATCH_DOCS] for whole in batches for at in range(0, len(whole), _BATCH_DOCS)):
            rows, windows = [], {}
            for doc_id, text in zip(b["id"].tolist(), b["text"], strict=True):
                h = shingle_hashes(text, size)
                n = len(h)
                sid = set_digest(h) if n else 0
                if n and sid not in seen:
                    seen.add(sid)
                    windows[len(rows)] = h[: n - need(n, num, den) + -(-n // 4)].view(np.int64)
                rows.append((doc_id, sid, n))
            out = pd.DataFrame(rows, columns=["id", "sid", "n"], dtype="int64")
            tokens, hot_tokens = [None] * len(rows), [None] * len(rows)
            hot, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if windows:
                hot, times = np.unique(np.concatenate(list(windows.values())), return_counts=True)
                hot, times = hot[times > local_hot], times[times > local_hot]
                for at, w in windows.items():
                    is_hot = np.isin(w, hot) if len(hot) else np.zeros(len(w), bool)
                    tokens[at], hot_tokens[at] = w[~is_hot], w[is_hot] if is_hot.any() else None
            yield out.assign(tokens=tokens, hot=hot_tokens, counts=None)
            if len(hot):
                yield pd.DataFrame({"id": [NO_ID], "sid": [0], "n": [-1], "tokens": [hot], "hot": [None], "counts": [times]})
        give_back()

    kept = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    # no nulls among the numbers on the way: pandas would make floats of them
    out = kept.mapInPandas(run, "id long, sid long, n long, tokens array<long>, hot array<long>, counts array<long>")
    return out.withColumn("sid", F.when(F.col("n") > 0, F.col("sid")))


def packed_windows(rows: DataFrame, buckets: int) -> DataFrame:
    """Windows and counted hot hashes as they are shuffled: for each batch and bucket of the
    hash range one array of hashes and one of their classes (of their counts, where hot).
    Hashes of a class lie together, so a class is written about once an array."""

    def pieces(arrays: list[np.ndarray], x: np.ndarray, is_hot: bool) -> pd.DataFrame:
        token = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
        bucket = (token.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        cut = lambda c: np.split(c[order], first[1:]) if len(names) else []
        return pd.DataFrame({"bucket": names, "is_hot": is_hot, "tokens": cut(token), "xs": cut(x)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (whole.iloc[at : at + _BATCH_DOCS] for whole in batches for at in range(0, len(whole), _BATCH_DOCS)):
            hot = b["counts"].notna().to_numpy()
            own, sums = b[~hot], b[hot]
            sizes = np.array([len(t) for t in own["tokens"]], np.int64)
            yield pieces(own["tokens"].tolist(), np.repeat(own["sid"].to_numpy(np.int64), sizes), False)
            if len(sums):
                yield pieces(sums["tokens"].tolist(), np.concatenate(sums["counts"].tolist()), True)
        give_back()

    kept = rows.filter("tokens is not null").select(F.coalesce("sid", F.lit(0)).alias("sid"), "tokens", "counts")
    return kept.mapInPandas(run, "bucket int, is_hot boolean, tokens array<long>, xs array<long>")


def short_lists(rows: DataFrame, num: int = NUM, den: int = DEN, local_hot: int = LOCAL_HOT) -> DataFrame:
    """(sid, n, rare, hot): the rarest window hashes of each class that can have a partner, and
    which of them are in more than ``local_hot`` classes."""
    total = rows.agg(F.sum(F.size("tokens").cast("long"))).first()[0] or 0
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, -(-total // BUCKET_TOKENS)))
    each = packed_windows(rows, buckets).repartitionById(buckets, F.col("bucket")).select("bucket", "is_hot", F.inline(F.arrays_zip("tokens", "xs")))
    each = each.select("bucket", F.col("tokens").alias("token"), F.when(~F.col("is_hot"), F.col("xs")).alias("sid"), F.when(F.col("is_hot"), F.col("xs")).otherwise(1).alias("times"))
    by = W.partitionBy("bucket", "token")  # a bucket is a partition: nothing moves
    seen = each.select("token", "sid", F.sum("times").over(by).alias("df"), F.min("sid").over(by).alias("lo"), F.max("sid").over(by).alias("hi"))
    # hashes of one class only can't join anything (hot ones are never alone)
    shared = seen.filter(F.col("sid").isNotNull() & ((F.col("lo") < F.col("hi")) | (F.col("df") > local_hot)))
    rank = F.when(F.col("df") > local_hot, F.lit(_HOT_RANK)).otherwise(F.col("df"))
    first = rows.filter("sid is not null and (tokens is not null or hot is not null)").select("sid", F.col("n").cast("long").alias("n"), "hot")
    back = shared.select("sid", rank.alias("rank"), "token").unionByName(first, allowMissingColumns=True)
    # a class has a row for each task that met it: whatever is not hot there was shuffled,
    # so the hot hashes of any one of them complete the others'
    kept = F.when(F.col("token").isNotNull(), F.struct("rank", "token"))
    sets = back.groupBy("sid").agg(F.max("n").alias("n"), F.max("hot").alias("hot"), F.collect_set(kept).alias("cold"))
    known = F.transform("cold", lambda x: x["token"])
    hot = F.transform(F.array_except(F.coalesce("hot", F.array().cast("array<bigint>")), known), lambda x: F.struct(F.lit(_HOT_RANK).alias("rank"), x.alias("token")))
    sets = sets.select("sid", "n", F.array_sort(F.concat("cold", hot)).alias("shared"))
    t = F.call_function("div", F.col("n") * num + (den - 1), F.lit(den))
    quarter = lambda c: F.call_function("div", c + 3, F.lit(4))
    window = F.least(F.col("n"), F.col("n") - t + quarter(F.col("n")))
    length = window - quarter(t) + 1
    take = (length - (window - F.size("shared"))).cast("int")  # hashes of its own come first, and join nothing
    chosen = sets.withColumn("take", take).filter("take > 0").select("sid", "n", F.slice("shared", 1, F.col("take")).alias("lists"))
    part = lambda keep: F.transform(F.filter("lists", keep), lambda x: x["token"])
    return chosen.select("sid", "n", part(lambda x: x["rank"] < _HOT_RANK).alias("rare"), part(lambda x: x["rank"] == _HOT_RANK).alias("hot"))


def _list_node(token: np.ndarray, band: np.ndarray) -> np.ndarray:
    """A node number for a list in a band; as a class's, a 64-bit digest."""
    x = (token.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31)) ^ band.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def rare_edges(lists: DataFrame) -> DataFrame:
    """Edges (u, v) from each node of a list and band, which are few, to the smallest one."""
    each = lists.select("node", "band", F.explode("rare").alias("token"))
    hubs = each.groupBy("token", "band").agg(F.min("node").alias("v"), F.max("node").alias("top")).filter("v < top").drop("top")
    return each.join(hubs, ["token", "band"]).filter("node <> v").select(F.col("node").alias("u"), "v").distinct()


def hot_edges(lists: DataFrame, edges_a_task: int = 1_000_000) -> DataFrame:
    """Edges (u, v) between nodes and their hot lists, which are nodes too, contracted in each
    task: about one edge a node stands for all that connects what a task has seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int]] = []
        for b in batches:
            if len(b):
                size = np.array([len(x) for x in b["hot"]])
                node = _list_node(np.concatenate([np.asarray(x, np.int64) for x in b["hot"]]), np.repeat(b["band"].to_numpy(np.int64), size))
                held += zip(np.repeat(b["node"].to_numpy(np.int64), size).tolist(), node.tolist(), strict=True)
            if len(held) > edges_a_task:
                held = spanning_stars(held)
                if len(held) > edges_a_task // 2:  # little to contract: hand on
                    yield pd.DataFrame(held, columns=["u", "v"], dtype="int64")
                    held = []
        yield pd.DataFrame(spanning_stars(held), columns=["u", "v"], dtype="int64")
        held.clear()
        give_back()

    return lists.filter(F.size("hot") > 0).select("node", "band", "hot").mapInPandas(run, "u long, v long")


def block_keys(members: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(sid, block) for members (sid, n, comp): every two classes of a component meet in
    some block, and no block holds more than about twice ``block_tokens`` hashes."""
    sizes = members.groupBy("comp").agg(F.sum("n").alias("_tokens"))
    total = sizes.agg(F.sum("_tokens")).first()[0] or 0
    bins = max(1, -(-total // block_tokens))
    parts = F.ceil(F.col("_tokens") / F.lit(block_tokens)).cast("int")
    rows = members.join(sizes, "comp").withColumn("_k", parts)
    chunk = F.pmod(F.xxhash64("sid", F.lit(1)), F.col("_k")).cast("int")
    whole = F.array(F.concat_ws("/", F.lit("bin"), F.pmod(F.xxhash64("comp"), F.lit(bins))))
    pairs = lambda c: F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda o: F.concat_ws("/", F.col("comp"), F.least(o, c), F.greatest(o, c)))
    return rows.withColumn("_c", chunk).select("sid", F.explode(F.when(F.col("_k") == 1, whole).otherwise(pairs(F.col("_c")))).alias("block"))


def id_bitmap(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of hashed ids and its number of bits, which grows with the ids up to
    2^MAX_FILTER_BITS and no further: beyond that it lets more ids pass, never fewer."""
    n = ids.count()
    bits = 1 << min(MAX_FILTER_BITS, max(15, (16 * n).bit_length()))
    at = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1  # these functions number bits from 1
    parts = ids.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # bits / 32768 rows
        piece = np.frombuffer(r.bits, np.uint8)
        low = (r.b - 1) * 4096
        out[low : low + 4096] = piece
    return out, bits


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(sid, hashes) of the classes in ``wanted`` (sid, id of a row that has the set), and
    now and then of another. Texts stay where they are read: a bounded bitmap of the wanted
    ids passes those whose sets are computed; the join with the blocks is exact."""
    bitmap, bits = id_bitmap(wanted.select("id"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = b["at"].to_numpy(np.int64)
            hit = b["text"].to_numpy()[(shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            for start in range(0, len(hit), _BATCH_DOCS):
                found = {}
                for text in hit[start : start + _BATCH_DOCS]:
                    h = shingle_hashes(text, size)
                    if len(h):
                        found[set_digest(h)] = h.tobytes()
                yield pd.DataFrame({"sid": list(found), "hashes": list(found.values())}).astype({"sid": "int64"})
        give_back()

    texts = docs.select(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))), F.lit(bits)).alias("at"), "text")
    return texts.mapInPandas(run, "sid long, hashes binary")


def block_links(sets: DataFrame, keys: DataFrame, num: int = NUM, den: int = DEN, every: bool = False) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates("sid").sort_values("sid")
        sids = g["sid"].tolist()
        found = link_block([np.frombuffer(x, np.uint64) for x in g["hashes"]], num, den, every)
        return pd.DataFrame([(sids[a], sids[b]) for a, b in found], columns=["u", "v"], dtype="int64")

    return sets.join(keys, "sid").groupBy("block").applyInPandas(run, "u long, v long")


def _blocks(docs: DataFrame, size: int, num: int, den: int, local_hot: int, block_tokens: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Window rows, classes, and the sets and keys of the blocks."""
    rows = materialize(window_rows(docs, size, num, den, local_hot), "jaccard-windows")
    lists = materialize(in_bands(short_lists(rows, num, den, local_hot), num, den), "jaccard-lists")
    coarse = connected_components(rare_edges(lists).unionByName(hot_edges(lists)), "jaccard-coarse")
    # a component's smallest node is no row of ``coarse``: it is added; lists go by the join with classes
    members = coarse.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(coarse.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    members = materialize(members.join(lists.select("node", "sid", "n", "own", "band"), "node"), "jaccard-nodes")
    # all of the band above: they meet there as well
    useful = members.groupBy("comp").agg(F.count("*").alias("_m"), F.min(F.col("own") - F.col("band")).alias("_low")).filter("_m > 1 and _low = 0").select("comp")
    classes = rows.filter("sid is not null").groupBy("sid").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.count("*").alias("times"))
    members = members.join(useful, "comp", "left_semi").select("sid", "comp")
    wanted = materialize(members.join(classes.drop("times"), "sid"), "jaccard-members")
    sets = full_sets(docs, wanted.select("sid", "id").distinct(), size)
    # written down, so that the engine knows their size: it broadcasts few, and shuffles many
    keys = materialize(block_keys(wanted.select("sid", "n", "comp"), block_tokens), "jaccard-keys")
    return rows, classes, sets, keys


def link_counts(docs: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN, local_hot: int = LOCAL_HOT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_shingles and n_links of every document: to how many other rows it links,
    those with the same set included. Every link is verified, none is skipped."""
    rows, classes, sets, keys = _blocks(docs, size, num, den, local_hot, block_tokens)
    # chunk pairs share classes: a link may be found in several blocks
    found = block_links(sets, keys, num, den, every=True).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links = materialize(found, "jaccard-all-links")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    times = classes.select("sid", "times")
    others = both.join(times, F.col("v") == F.col("sid")).groupBy("u").agg(F.sum("times").alias("others"))
    each = times.join(others, F.col("sid") == F.col("u"), "left").select("sid", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    each, total = materialize(each.join(times, "sid"), "jaccard-counts"), rows.count()
    out = hot_join(rows.filter("n >= 0").select("id", "sid", "n"), each, ["sid"], F.col("times") * HOT_KEYS > total, "left")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN, local_hot: int = LOCAL_HOT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows, classes, sets, keys = _blocks(docs, size, num, den, local_hot, block_tokens)
    links = connected_components(block_links(sets, keys, num, den), "jaccard-links")
    named = links.join(classes.select("sid", "id"), F.col("u") == F.col("sid")).groupBy("v").agg(F.min("id").alias("low"))
    ends = named.join(classes.select("sid", "id"), F.col("v") == F.col("sid")).select("v", F.least("low", "id").alias("component"))
    linked = links.join(ends, "v").select(F.col("u").alias("sid"), "component").unionByName(ends.select(F.col("v").alias("sid"), "component"))
    # classes of several rows or with links: the others' component is their own id
    answer = classes.join(linked, "sid", "left").filter("times > 1 or component is not null").select("sid", "times", F.coalesce("component", "id").alias("component"))
    answer, total = materialize(answer, "jaccard-answer"), rows.count()
    out = hot_join(rows.filter("n >= 0").select("id", "sid", "n"), answer, ["sid"], F.col("times") * HOT_KEYS > total, "left")
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(real(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("component", "id")).alias("component_id"))


def keep_one(docs: DataFrame, **how: int) -> DataFrame:
    """``docs`` with one row of each linked group: one with the smallest id, null ids last.

    Rows are numbered in a written copy and judged by their number, so repeated and null
    ids are rows like any other."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number"))
    rows = materialize(whole, "jaccard-rows")
    found = jaccard_components(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), **how)
    tied = materialize(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("number"), F.col("component_id").alias("comp")), "jaccard-tied")
    # the row a component is named by is no row of ``tied``: it is added
    members = tied.unionByName(tied.select(F.col("comp").alias("number"), "comp").distinct())
    ids = rows.select("number", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    first = members.join(ids, "number").groupBy("comp").agg(F.min(F.struct("id", "number"))["number"].alias("number"))
    gone = materialize(members.select("number").join(first, "number", "left_anti"), "jaccard-gone")
    return rows.join(gone, "number", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


