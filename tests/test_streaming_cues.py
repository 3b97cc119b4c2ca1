import json
import os
import random
import time

import pytest

from cuespan.operators import sequence
from cuespan.streaming import cues

SCHEMA = "video_id string, seq long, start double, text string, last boolean"


def lecture(rng, video, n):
    at, out = 0.0, []
    for seq in range(n):
        out.append((video, seq, round(at, 2), rng.choice(["a", "b", "b", "c d", ""]), False))
        at += rng.choice([0.0, 1.5, 4.0, 4.0, 9.0, 36.0, 200.0])
    return out


def batch_of(spark, rows):
    phrases = spark.createDataFrame([r[:4] for r in rows], "video_id string, seq long, start double, text string")
    segments = sequence.segments_of(phrases)
    return sorted(map(tuple, segments.collect())), sorted(map(tuple, sequence.sliding_chunks(segments).collect()))


@pytest.mark.parametrize("seed", range(25))
def test_any_cut_gives_the_same_rows(seed):
    """The state alone, without an engine: cuts anywhere, the state written down between them."""
    rng = random.Random(seed)
    rows = [r[1:4] for r in lecture(rng, "v", rng.randint(0, 60))]

    def run(cuts):
        state, segments, chunks = cues.Cues(), [], []
        for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            state = cues.Cues(json.loads(json.dumps(state.held)))
            part = rows[lo:hi]
            rng.shuffle(part)
            some = list(state.segments(part))
            segments += some
            chunks += state.chunks(some, 45.0, 35.0)
        some = list(state.last_segment())
        return segments + some, chunks + list(state.chunks(some, 45.0, 35.0, last=True))

    whole = run([])
    for _ in range(10):
        assert run(sorted(rng.sample(range(len(rows) + 1), min(len(rows), rng.randint(1, 6))))) == whole


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    videos = {v: lecture(rng, v, n) for v, n in (("v", 60), ("w", 25), ("x", 1))}
    want_segments, want_chunks = batch_of(spark, [r for rows in videos.values() for r in rows])
    # four files, each a micro-batch; the end mark of a video comes with its last cue or alone
    cut = {v: sorted(rng.sample(range(len(rows) + 1), min(3, len(rows)))) for v, rows in videos.items()}
    (tmp_path / "in").mkdir()
    for b in range(4):
        part = []
        for v, rows in videos.items():
            ends = [0, *cut[v], *[len(rows)] * (4 - len(cut[v]))]
            part += rows[ends[b] : ends[b + 1]]
            if b == 3:
                part.append((v, None, None, None, True))
        rng.shuffle(part)
        path = tmp_path / f"b{b}"
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(path))
        name = next(p for p in path.iterdir() if p.suffix == ".parquet")
        target = tmp_path / "in" / f"{b}.parquet"
        name.rename(target)
        os.utime(target, (1_000_000 + b, 1_000_000 + b))
    old = spark.conf.get(cues.STORE[0], None)
    spark.conf.set(*cues.STORE)
    try:
        for shape, make, want in (("s", cues.segment_stream, want_segments), ("c", cues.chunk_stream, want_chunks)):
            rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            query = make(rows).writeStream.format("parquet").option("path", str(tmp_path / f"out-{shape}")).option("checkpointLocation", str(tmp_path / f"cp-{shape}")).trigger(availableNow=True).start()
            query.awaitTermination()
            got = spark.read.parquet(str(tmp_path / f"out-{shape}"))
            assert sorted(map(tuple, got.collect())) == want and want
        # a video that just stops: a timer ends it
        spark.createDataFrame([("t", 0, 1.0, "a", False), ("t", 1, 5.0, "b", False)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "timed"))
        rows = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "timed"))
        query = cues.segment_stream(rows, idle=0.5).writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "cp-t")).start()
        try:
            until = time.time() + 60
            while spark.table("timed").count() < 2 and time.time() < until:
                time.sleep(1)
            assert sorted(map(tuple, spark.table("timed").collect())) == [("t", 0, 1.0, 5.0, "a"), ("t", 1, 5.0, 8.0, "b")]
        finally:
            query.stop()
    finally:
        spark.conf.set(cues.STORE[0], old) if old else spark.conf.unset(cues.STORE[0])
