import io
import random
import struct
import time

from pyspark.sql import functions as F

from cuespan import models
from cuespan.sources import captions, media


def wav(seconds=1.0, rate=8000, channels=1, bits=16, before=b"", said=None, there=None, form=True, kind=b"RIFF"):
    align = channels * bits // 8
    data = b"\x01" * int(seconds * rate * align)
    data = data if there is None else data[:there]
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * align, align, bits) if form else b""
    body = b"WAVE" + before + fmt + b"data" + struct.pack("<I", len(data) if said is None else said) + data
    return kind + struct.pack("<I", len(body)) + body


def header(raw):
    return media.wav_header(io.BytesIO(raw), len(raw))


def test_wav_headers():
    assert header(wav(1.5)) == (1, 8000, 16, 1.5, False, None)
    assert header(wav(2, 44100, 2, 24)) == (2, 44100, 24, 2.0, False, None)
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"JUNK" + struct.pack("<I", 4) + b"data"
    assert header(wav(1, before=odd)) == (1, 8000, 16, 1.0, False, None)
    assert header(wav(2, said=32000, there=16001)) == (1, 8000, 16, 1.0, True, None)  # cut inside a sample
    assert header(wav(1, said=0xFFFFFFFF)) == (1, 8000, 16, 1.0, False, None)  # written as a stream
    ds64 = lambda n: b"ds64" + struct.pack("<IQQQI", 28, 0, n, 0, 0)
    assert header(wav(1, before=ds64(16000), said=0xFFFFFFFF, kind=b"RF64")) == (1, 8000, 16, 1.0, False, None)
    assert header(wav(1, before=ds64(1 << 40), said=0xFFFFFFFF, kind=b"RF64"))[3:] == (1.0, True, None)
    assert header(wav(1, form=False))[5] == "no format before the data" and header(wav(0))[3] == 0.0
    assert header(b"")[5] == header(b"RIFF1234AVI ")[5] == "not a WAV file"
    whole = wav(0.25, before=odd)
    for n in range(len(whole)):  # cut anywhere: a row, and no error
        seconds, problem = header(whole[:n])[3], header(whole[:n])[5]
        assert (seconds is None) == (problem is not None) and (seconds or 0) <= 0.25


def test_wav_source(spark, tmp_path):
    rows = [(f"v{i}.x.wav", bytearray(wav(i / 10))) for i in range(40)] + [("bad.wav", bytearray(b"no")), ("v1.txt", bytearray(b""))]
    folder = str(tmp_path / "sound")
    media.write_files(spark.createDataFrame(rows, "name string, content binary").repartition(3), folder)
    media.register(spark)
    found = spark.read.format("wav_headers").option("filesPerTask", 7).load(folder)
    assert found.rdd.getNumPartitions() == 6
    got = {r.video_id: (r.seconds, r.problem) for r in found.collect()}
    assert got == {**{f"v{i}": (i / 10, None) for i in range(40)}, "bad": (None, "not a WAV file")}
    assert spark.read.format("wav_headers").load(f"{folder}/v3.x.wav").first().seconds == 0.3
    (tmp_path / "none").mkdir()
    assert spark.read.format("wav_headers").load(str(tmp_path / "none")).count() == 0


def test_cues_are_those_of_whole_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    parts = ["WEBVTT", "00:00:01.000 --> 00:00:02.500", "00:00:03.000-->00:01:04.000 align:start", "<c>word</c> two", "  ", " ", "NOTE é", "12", "00:00:05.000 --> x", "<b></b>", "last"]
    ends = ["\n", "\n\n", "\r\n", "\r\n\r\n", "\r", "\n\n\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(ends) for _ in range(rng.randint(0, 30))) for _ in range(150)] + ["", "\n\n \n", "00:00:01.000 --> 00:00:02.000\nx"]
    texts += ["WEBVTT\n\n" + "\n\n".join(f"00:00:{i % 60:02d}.000 --> 00:01:00.000\né{'y' * 300} {i}" for i in range(900))]  # longer than the buffer
    files = spark.createDataFrame([(f"v{i}", t) for i, t in enumerate(texts)], "video_id string, raw string")
    folder = str(tmp_path / "cues")
    media.write_files(files.select(F.concat("video_id", F.lit(".en.vtt")).alias("name"), F.col("raw").cast("binary").alias("content")), folder)
    media.register(spark)
    flat = lambda df: sorted((r.video_id, r.seq, r.start, r.end, tuple(r.text_lines)) for r in df.collect())
    got, want = flat(spark.read.format("caption_cues").load(folder)), flat(captions.parse_cues(files))
    assert got == want and len(got) > 1000


def test_lanes_bound_the_rate_of_all_tasks():
    """Lanes with clocks of their own: calls of random length, lanes that come late."""
    rng = random.Random(1)
    rate, lanes, starts = 10.0, 4, []
    for number in range(lanes):
        now = [rng.choice([0.0, 0.0, 3.7])]
        lane = models.Lane(rate, lanes, number, clock=lambda now=now: now[0], sleep=lambda s, now=now: now.__setitem__(0, now[0] + s))
        for _ in range(100):
            lane.wait()
            starts.append(now[0])
            now[0] += rng.choice([0.0, 0.01, 2.0])
    starts.sort()
    for i in range(len(starts)):
        assert sum(starts[i] <= t < starts[i] + 1 for t in starts[i:]) <= rate + lanes


def test_replies_at_a_rate(spark):
    rows = spark.range(40).select("id", F.lit("p").alias("prompt")).repartition(8)

    def load():
        calls = []

        def model(prompt):
            calls.append(1)
            if len(calls) % 3 == 1:
                raise ValueError("again")
            return repr(time.time())

        return model

    got = models.with_reply(rows, "prompt", load, attempts=4, rate=20, lanes=2).collect()
    at = sorted(float(r.reply) for r in got)
    assert len(at) == 40 and {r.id for r in got} == set(range(40))
    # two replies of three calls: 60 calls at 20 a second take 3 seconds, less the edges
    assert at[-1] - at[0] > 2.5 and all(at[i + 23] - at[i] >= 0.95 for i in range(len(at) - 23))
