"""Files that are read in place: headers of sound files, and captions cue by cue.

Two Python data sources with planned partitions: the driver lists a folder and deals its files
to partitions, a task opens one file at a time, and no file is ever held whole. Paths are
what pyarrow's file systems open: local and shared folders, HDFS, and object stores.

    register(spark)
    spark.read.format("wav_headers").load(folder)
    spark.read.format("caption_cues").load(folder)
"""

from __future__ import annotations

import codecs
import io
import re
import struct
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import TAG

FILES_A_TASK = 256
BUFFER = 1 << 16
_UNKNOWN = 0xFFFFFFFF  # the length of a chunk that was written as a stream, or stands in ds64
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_TIMES = re.compile(r"(\d{2}):(\d{2}):(\d{2}\.\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2}\.\d{3})", re.ASCII)


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}")


class _Reader(DataSourceReader):
    """Deals the files with a suffix below a folder to partitions."""

    suffix = ""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.many = int(options.get("filesPerTask", FILES_A_TASK))

    def partitions(self) -> list[Files]:
        store, root = _open(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        names = sorted(x.path for x in found if x.type == fs.FileType.File and x.path.lower().endswith(self.suffix))
        return [Files(names[at : at + self.many]) for at in range(0, len(names), self.many)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _open(self.path)
        for name in partition.paths:
            with store.open_input_file(name) as f:
                yield from self.rows(name, f)

    def rows(self, name: str, f) -> Iterable[tuple]:
        raise NotImplementedError


# --- sound -------------------------------------------------------------------------------


def wav_header(f, size: int) -> tuple:
    """(channels, sample_rate, bits, seconds, truncated, problem) of a RIFF or RF64 file: its
    chunks are walked by seeking, with the pad byte after those of odd length. Seconds are of
    the whole samples that are there; ``truncated`` says that the header promised more."""

    def read_at(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    head, at, form, long_data = read_at(0, 12), 12, None, None
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        return None, None, None, None, None, "not a WAV file"
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read_at(at, 8))
        at += 8
        if name == b"ds64" and length >= 16:
            long_data = struct.unpack("<Q", read_at(at + 8, 8))[0]
        elif name == b"fmt " and length >= 16 and at + 16 <= size:
            _, channels, rate, _, align, bits = struct.unpack("<HHIIHH", read_at(at, 16))
            form = (channels, rate, bits, align)
        elif name == b"data":
            if form is None or not form[1] or not form[3]:
                return None, None, None, None, None, "no format before the data"
            there = size - at
            said = there if length == _UNKNOWN and long_data is None else long_data if length == _UNKNOWN else length
            return (*form[:3], min(said, there) // form[3] / form[1], said > there, None)
        at += length + (length & 1)
    return None, None, None, None, None, "no data"


class _WavReader(_Reader):
    suffix = ".wav"

    def rows(self, name: str, f) -> Iterator[tuple]:
        size = f.size()
        yield (name, name.rsplit("/", 1)[-1].split(".")[0], size, *wav_header(f, size))


class WavHeaders(DataSource):
    """One row a ``.wav`` file; a file that can't be read has a ``problem`` and no seconds."""

    @classmethod
    def name(cls) -> str:
        return "wav_headers"

    def schema(self) -> str:
        return "path string, video_id string, bytes long, channels int, sample_rate long, bits int, seconds double, truncated boolean, problem string"

    def reader(self, schema) -> DataSourceReader:
        return _WavReader(self.options)


# --- captions ----------------------------------------------------------------------------


def text_lines(f) -> Iterator[str]:
    """Lines of an open file, whatever ends them; bytes that are no UTF-8 become marks."""
    decoder, rest = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")("replace"), True), ""
    while piece := f.read(BUFFER):
        *whole, rest = (rest + decoder.decode(piece)).split("\n")
        yield from whole
    yield from (rest + decoder.decode(b"", True)).split("\n")


def cue_blocks(lines: Iterable[str]) -> Iterator[tuple[int, list[str]]]:
    """Numbered blocks of lines between empty lines; blank lines before the first don't count."""
    n, block = 0, []
    for line in lines:
        if not n and not block and not line.strip(_BLANK):
            continue
        if line:
            block.append(line)
        elif block:
            yield n, block
            n, block = n + 1, []
    if block:
        yield n, block


def cue_of(block: list[str]) -> tuple[float, float, list[str]] | None:
    """Start, end and text of a block: its first line with times counts, and what follows it
    without tags; None without times or without text."""
    block = "\n".join(block).strip(_BLANK).split("\n")
    for i, line in enumerate(block):
        if m := _TIMES.search(line):
            seconds = [int(h) * 3600 + int(n) * 60 + float(s) for h, n, s in (m.groups()[:3], m.groups()[3:])]
            text = [t for x in block[i + 1 :] if (t := re.sub(TAG, "", x).strip(_BLANK))]
            return (*seconds, text) if text else None
    return None


class _CueReader(_Reader):
    suffix = ".vtt"

    def rows(self, name: str, f) -> Iterator[tuple]:
        video = name.rsplit("/", 1)[-1].split(".")[0]
        for n, block in cue_blocks(text_lines(f)):
            if found := cue_of(block):
                yield (video, n, *found)


class CaptionCues(DataSource):
    """The cues of ``.vtt`` files, as ``captions.parse_cues`` makes them of whole texts."""

    @classmethod
    def name(cls) -> str:
        return "caption_cues"

    def schema(self) -> str:
        return "video_id string, seq long, start double, end double, text_lines array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _CueReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavHeaders)
    spark.dataSource.register(CaptionCues)


def write_files(rows: DataFrame, folder: str) -> None:
    """A file for each row (name, content), written by the tasks that have the rows."""

    def write(some: Iterable) -> None:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        for r in some:
            with store.open_output_stream(f"{root}/{r.name}") as f:
                f.write(bytes(r.content))

    rows.select("name", "content").foreachPartition(write)
