"""Recordings base_YYYYMMDD_HHMMSS.wav as sample blocks: a data source whose tasks read ranges of bytes."""

from __future__ import annotations

import calendar
import io
import math
import re
import struct
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

BLOCK_SECONDS = 10
RANGE_BYTES = 128 << 20
SCHEMA = "run_id int, channel int, block_no bigint, start_sample bigint, fs double, samples array<double>"
_ARROW = pa.schema([("run_id", pa.int32()), ("channel", pa.int32()), ("block_no", pa.int64()), ("start_sample", pa.int64()), ("fs", pa.float64()), ("samples", pa.list_(pa.float64()))])
#: Stores that tasks read by range; others are read through Spark, a file per task.
SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs")


def _scheme(directory: str) -> str:
    return re.match(r"(?:([a-z][a-z0-9+.-]*):)?", directory)[1] or ""


def _store(directory: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it."""
    scheme = _scheme(directory)
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), re.sub(r"^file:(//)?", "", directory)
    return pafs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", directory))


def _stamp(text: str) -> int | None:
    """Seconds of YYYYMMDD_HHMMSS; None if there is no such time."""
    try:
        return calendar.timegm(time.strptime(text, "%Y%m%d_%H%M%S"))
    except ValueError:
        return None


@dataclass
class _Format:
    channels: int
    fs: int
    kind: str  # of a sample: u1, i2, i3, i4, f4, f8
    at: int  # first byte of the frames
    frames: int

    @property
    def frame(self) -> int:
        return self.channels * int(self.kind[1])


#: (format tag, bytes a sample) and what a sample is.
_KINDS = {(1, 1): "u1", (1, 2): "i2", (1, 3): "i3", (1, 4): "i4", (3, 4): "f4", (3, 8): "f8"}


def _header(read_at, size: int, name: str) -> _Format:
    """Chunks before the frames; ``read_at(n, offset)`` gives bytes. 64-bit sizes are
    known, and a file cut short ends with its last whole frame."""
    start = read_at(12, 0)
    if start[:4] not in (b"RIFF", b"RF64", b"BW64") or start[8:] != b"WAVE":
        raise ValueError(f"{name} is no wave file")
    at, fmt, long_size = 12, None, None
    while at + 8 <= size:
        tag, length = struct.unpack("<4sI", read_at(8, at))
        at += 8
        if tag == b"ds64":
            long_size = struct.unpack("<Q", read_at(8, at + 8))[0]
        elif tag == b"fmt ":
            fmt = read_at(length, at)
        elif tag == b"data" and fmt is not None:
            code, channels, fs, _, frame, bits = struct.unpack("<HHIIHH", fmt[:16])
            code = struct.unpack("<H", fmt[24:26])[0] if code == 0xFFFE else code
            kind = _KINDS.get((code, frame // max(channels, 1)))
            if kind is None or frame != channels * int(kind[1]) or fs == 0:
                raise ValueError(f"{name}: format {code} with {channels} channels in frames of {frame} bytes ({bits} bits) at {fs} Hz is not read")
            held = long_size if long_size is not None and length == 0xFFFFFFFF else length
            return _Format(channels, fs, kind, at, min(held, size - at) // frame)
        at += length + length % 2
    raise ValueError(f"{name} has no format and frames")


def _scaled(raw: bytes, kind: str, channels: int) -> np.ndarray:
    """Samples (frame, channel) as they stand; see ``_real``."""
    if kind != "i3":
        return np.frombuffer(raw, "<" + kind).reshape(-1, channels)
    parts = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    wide = np.zeros((len(parts), 4), np.uint8)
    wide[:, 1:] = parts
    return (wide.view("<i4") >> 8).reshape(-1, channels)


def _real(samples: np.ndarray, kind: str) -> np.ndarray:
    """Whole numbers scaled to [-1, 1); floating ones unchanged."""
    if kind[0] == "f":
        return samples.astype(float)
    if kind == "u1":
        return (samples.astype(float) - 128) / 128
    return samples / float(1 << 8 * int(kind[1]) - 1)


@dataclass
class _Bounds:
    """What is wanted: seconds [start, stop) from the epoch, samples and channels."""

    start: float = -math.inf
    stop: float = math.inf
    first_sample: float = -math.inf
    last_sample: float = math.inf
    channels: frozenset | None = None


def _blocks(read_at, size: int, name: str, t: int, t0: int, first: int, stop: int, run_id: int, block_s: float, want: _Bounds):
    """Batches of the blocks of a recording that begin in its bytes [first, stop): a row per wanted channel."""
    form = _header(read_at, size, name)
    step = max(1, round(block_s * form.fs))
    k = max(0, -((form.at - first) // (step * form.frame)))
    while k * step < form.frames and form.at + k * step * form.frame < stop:
        begin = round((t - t0) * form.fs) + k * step
        wanted = want.first_sample <= begin <= want.last_sample and want.start <= t + k * block_s < want.stop
        channels = [c for c in range(form.channels) if want.channels is None or c in want.channels]
        if wanted and channels:
            count = min(step, form.frames - k * step)
            held = _scaled(read_at(count * form.frame, form.at + k * step * form.frame), form.kind, form.channels)
            for c in channels:
                row = [[run_id], [c], [math.floor((t - t0) / block_s) + k], [begin], [float(form.fs)], [_real(held[:, c], form.kind)]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _ARROW)], schema=_ARROW)
        k += 1


@dataclass
class _Range(InputPartition):
    path: str
    size: int
    t: int
    t0: int
    first: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.directory, self.base = options["path"], options["base"]
        self.run_id = int(options.get("run_id", 0))
        self.block_s = float(options.get("block_seconds", BLOCK_SECONDS))
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.want = _Bounds()
        for side in ("start", "stop"):
            if side in options:
                held = _stamp(options[side])
                if held is None:
                    raise ValueError(f"{side} must be YYYYMMDD_HHMMSS, not {options[side]}")
                setattr(self.want, side, held)
        if "channels" in options:
            self._among(int(c) for c in options["channels"].split(",") if c.strip())

    def _among(self, channels) -> None:
        held = frozenset(channels)
        self.want.channels = held if self.want.channels is None else self.want.channels & held

    def partitions(self):
        """Ranges of bytes of the files, known from the listing alone."""
        store, directory = _store(self.directory)
        name = re.compile(re.escape(self.base) + r"_(\d{8}_\d{6})\.wav")
        found = []
        for info in store.get_file_info(pafs.FileSelector(directory)):
            hit = name.fullmatch(info.base_name)
            t = _stamp(hit[1]) if hit else None
            if t is not None:
                found.append((t, info.path, info.size))
        t0 = min((t for t, _, _ in found), default=0)
        cut = [_Range(path, size, t, t0, at, at + self.range_bytes) for t, path, size in sorted(found) if t < self.want.stop for at in range(0, size, self.range_bytes)]
        return cut or [_Range("", 0, 0, 0, 0, 0)]

    def read(self, partition: _Range):
        if not partition.path:
            return
        store, _ = _store(self.directory)
        with store.open_input_file(partition.path) as f:
            p = partition
            yield from _blocks(f.read_at, p.size, p.path, p.t, p.t0, p.first, p.stop, self.run_id, self.block_s, self.want)


class _FilteredReader(_Reader):
    """Where the session lets Python sources see conditions."""

    def pushFilters(self, filters):
        """Bounds on start_sample and channel spare blocks and channels; Spark tests them again."""
        want = self.want
        for f in filters:
            at = getattr(f, "attribute", None)
            if at == ("channel",) and isinstance(f, EqualTo):
                self._among([f.value])
            elif at == ("channel",) and isinstance(f, In):
                self._among(f.value)
            elif at == ("start_sample",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                want.first_sample = max(want.first_sample, f.value)
            if at == ("start_sample",) and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                want.last_sample = min(want.last_sample, f.value)
            yield f


class Recordings(DataSource):
    """``spark.read.format("recordings").option("base", ...).load(directory)``.

    Rows run_id, channel, block_no, start_sample, fs, samples. Samples count from
    the earliest recording of the base; a recording is cut into blocks of
    ``block_seconds``, and a block belongs to the range of ``range_bytes`` in which
    it begins, so a long file is read by many tasks and no file as a whole. The
    options start and stop (YYYYMMDD_HHMMSS, of blocks' beginnings) and channels
    (numbers with commas) leave the rest unread; with push_filters, which needs
    spark.sql.python.filterPushdown.enabled, so do conditions on channel and
    start_sample. Samples of 8, 16, 24, 32 bits and floats of 32 and 64 bits are
    read; other formats are an error that names the file. Names without a valid
    time are passed over; a folder without recordings gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        pushing = str(self.options.get("push_filters", "false")).lower() == "true"
        return (_FilteredReader if pushing else _Reader)(dict(self.options))


def ingest_wav(spark: SparkSession, directory: str, base: str, run_id: int = 0, start: str | None = None, stop: str | None = None, channels: list[int] | None = None, block_seconds: float = BLOCK_SECONDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Blocks of recordings base_YYYYMMDD_HHMMSS.wav, see ``Recordings``.

    Stores that only Spark reads give the same rows with a file per task.
    """
    options = {"path": directory, "base": base, "run_id": run_id, "start": start, "stop": stop, "block_seconds": block_seconds, "range_bytes": range_bytes, "channels": None if channels is None else ",".join(map(str, channels))}
    options = {k: str(v) for k, v in options.items() if v is not None}
    if _scheme(directory) in SCHEMES:
        spark.dataSource.register(Recordings)
        options["push_filters"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
        return spark.read.format("recordings").options(**options).load()
    reader = _Reader(options)
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{base}_*.wav").load(directory).select("path", "content")
    name = F.regexp_extract("path", r"_(\d{8}_\d{6})\.wav$", 1)
    named = found.withColumn("t", F.unix_seconds(F.try_to_timestamp(name, F.lit("yyyyMMdd_HHmmss")))).filter("t is not null")
    t0 = named.agg(F.min("t").alias("t0"))
    stamped = named.join(F.broadcast(t0)).select("path", "content", name.alias("at"), "t", "t0")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                content, t = row["content"], _stamp(row["at"])
                part = lambda n, at: content[at : at + n]  # noqa: B023, E731
                yield from _blocks(part, len(content), row["path"], t, t - (row["t"] - row["t0"]), 0, len(content), reader.run_id, reader.block_s, reader.want)

    return stamped.mapInArrow(read, SCHEMA)


def write_wav(blocks: DataFrame, directory: str, base: str, start: str, fs: int, n_channels: int, block_s: int = BLOCK_SECONDS, blocks_per_file: int = 6) -> int:
    """Write blocks (channel, block_no, samples in [-1, 1)) as 16-bit recordings of
    ``blocks_per_file`` blocks, a file per task; missing blocks are silent. Returns
    the number of files. A task that runs again writes the same file again."""
    t0 = _stamp(start)
    held = blocks.groupBy(F.floor(F.col("block_no") / blocks_per_file).alias("file")).agg(F.collect_list(F.struct("block_no", "channel", "samples")).alias("b"))
    held = held.select("file", F.col("b.block_no").alias("block_no"), F.col("b.channel").alias("channel"), F.col("b.samples").alias("samples"))

    def write(batches):
        import wave

        store, folder = _store(directory)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for file, numbers, channels, samples in zip(batch["file"], batch["block_no"], batch["channel"], batch["samples"]):
                first, step = int(file) * blocks_per_file, block_s * fs
                frames = np.zeros(((max(numbers) - first + 1) * step, n_channels))
                for number, channel, given in zip(numbers, channels, samples):
                    frames[(number - first) * step :, channel][: len(given)] = given
                whole = np.clip(np.floor(frames * 32768 + 0.5), -32768, 32767).astype("<i2")
                out = io.BytesIO()
                with wave.open(out, "wb") as w:
                    w.setparams((n_channels, 2, fs, 0, "NONE", ""))
                    w.writeframes(whole.tobytes())
                at = time.strftime("%Y%m%d_%H%M%S", time.gmtime(t0 + first * block_s))
                with store.open_output_stream(f"{folder.rstrip('/')}/{base}_{at}.wav") as f:
                    f.write(out.getvalue())
            yield batch[["file"]]

    return held.mapInPandas(write, "file bigint").count()
