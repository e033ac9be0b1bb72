"""Recordings read by ranges of bytes."""

import struct
import wave

import numpy as np
import pytest

from sensorline.sources import recordings


def _chunk(tag: bytes, body: bytes, length: int | None = None) -> bytes:
    return tag + struct.pack("<I", len(body) if length is None else length) + body + b"\0" * (len(body) % 2)


def _wav(code: int, channels: int, fs: int, width: int, body: bytes, extra: bytes = b"", start: bytes = b"RIFF", data: int | None = None) -> bytes:
    fmt = struct.pack("<HHIIHH", code, channels, fs, fs * channels * width, channels * width, 8 * width)
    if code == 0xFFFE:
        fmt += struct.pack("<HHI", 22, 8 * width, 0) + struct.pack("<H", 1) + b"\0" * 14
    return start + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + extra + _chunk(b"fmt ", fmt) + _chunk(b"data", body, data)


def _read(spark, folder, **options):
    rows = recordings.ingest_wav(spark, f"{folder}", "x", **options).collect()
    return {(r.channel, r.block_no): (r.start_sample, r.fs, r.samples) for r in rows}


def test_ranges_of_any_size_give_the_blocks_once(spark, tmp_path):
    values = np.random.default_rng(3).integers(-32768, 32768, (1000, 3)).astype("<i2")
    for k in range(2):
        (tmp_path / f"x_20200101_0000{k * 20:02d}.wav").write_bytes(_wav(1, 3, 50, 2, values[k * 500 :][: 1000 - k * 500].tobytes(), _chunk(b"LIST", b"odd")))
    (tmp_path / "x_20201301_000000.wav").write_bytes(b"no such month")
    (tmp_path / "y_20200101_000000.wav").write_bytes(b"another base")
    whole = {(r.channel, r.start_sample): r for r in recordings.ingest_wav(spark, f"{tmp_path}", "x", block_seconds=3).collect()}
    assert len(whole) == 3 * (7 + 4)
    for (channel, start), r in whole.items():
        at = start if start < 1000 else start - 500
        stop = min(at + 150, 1000)
        assert r.fs == 50 and r.block_no == (start // 150 if start < 1000 else 6 + (start - 1000) // 150)
        assert r.samples == (values[at:stop, channel] / 32768).tolist()
    for size in (100, 901, 1000, 5000):
        got = recordings.ingest_wav(spark, f"{tmp_path}", "x", block_seconds=3, range_bytes=size)
        assert got.rdd.getNumPartitions() >= 9000 // size
        assert {(r.channel, r.start_sample): r.samples for r in got.collect()} == {k: r.samples for k, r in whole.items()}


def test_times_and_channels_are_cut_before_reading(spark, tmp_path):
    values = np.arange(2000, dtype="<i2").reshape(-1, 2)
    (tmp_path / "x_20200101_000000.wav").write_bytes(_wav(1, 2, 10, 2, values.tobytes()))
    got = _read(spark, tmp_path, start="20200101_000020", stop="20200101_000041", channels=[1])
    assert sorted(got) == [(1, 2), (1, 3), (1, 4)]
    assert got[1, 2][0] == 200 and got[1, 2][2][0] == 401 / 32768
    assert _read(spark, tmp_path, stop="20200101_000000") == {}
    with pytest.raises(ValueError, match="YYYYMMDD"):
        recordings._Reader({"path": "/", "base": "x", "start": "noon"})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        frame = recordings.ingest_wav(spark, f"{tmp_path}", "x").filter("channel = 0 and start_sample >= 300 and start_sample < 500")
        assert sorted((r.channel, r.start_sample) for r in frame.collect()) == [(0, 300), (0, 400)]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    reader = recordings._FilteredReader({"path": "/", "base": "x"})
    list(reader.pushFilters([recordings.EqualTo(("channel",), 1), recordings.GreaterThan(("start_sample",), 5), recordings.LessThan(("start_sample",), 9)]))
    assert (reader.want.channels, reader.want.first_sample, reader.want.last_sample) == (frozenset({1}), 5, 9)


@pytest.mark.parametrize("kind", ["u1", "i2", "i3", "i4", "f4", "f8", "extensible", "rf64", "cut", "endless"])
def test_widths_and_long_headers(kind):
    values = np.array([[-1.0, 0.5], [0.25, -0.125], [0.0, 0.75]])
    wide = kind if kind in ("u1", "i3", "i4", "f4", "f8") else "i2"
    if wide[0] == "f":
        body = values.astype("<" + wide).tobytes()
    elif wide == "u1":
        body = (values * 128 + 128).astype(np.uint8).tobytes()
    elif wide == "i3":
        body = (values * (1 << 23)).astype("<i4").ravel().view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        body = (values * (1 << 8 * int(wide[1]) - 1)).astype("<" + wide).tobytes()
    code = 0xFFFE if kind == "extensible" else 3 if wide[0] == "f" else 1
    extra = _chunk(b"ds64", struct.pack("<QQQI", 0, len(body), 3, 0)) if kind == "rf64" else b""
    data = {"rf64": 0xFFFFFFFF, "endless": 0xFFFFFFFF}.get(kind)
    made = _wav(code, 2, 8, int(wide[1]), body, extra, b"RF64" if extra else b"RIFF", data)
    made = made[:-1] if kind == "cut" else made
    got = list(recordings._blocks(lambda n, at: made[at : at + n], len(made), "f", 0, 0, 0, len(made), 0, 10, recordings._Bounds()))
    samples = [b.column("samples")[0].as_py() for b in got]
    assert np.array(samples).T.tolist() == values[: 2 if kind == "cut" else 3].tolist()


@pytest.mark.parametrize("made", [b"", b"RIFF0000WAVE", _wav(1, 2, 8, 5, b"0" * 10), _wav(2, 1, 8, 2, b"0000"), _wav(1, 1, 0, 2, b"0000"), b"OggS" + b"0" * 40])
def test_other_files_are_an_error_with_their_name(made):
    with pytest.raises(ValueError, match="odd.wav"):
        recordings._header(lambda n, at: made[at : at + n], len(made), "odd.wav")


def test_empty_folder_and_round_trip(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert _read(spark, tmp_path / "none") == {}
    blocks = spark.createDataFrame([(0, 0, [0.5, -0.5]), (1, 3, [0.25])], "channel int, block_no long, samples array<double>")
    assert recordings.write_wav(blocks, f"file://{tmp_path}/w", "x", "20200101_235959", 2, 2, 1, 2) == 2
    with wave.open(f"{tmp_path}/w/x_20200102_000001.wav") as w:
        assert (w.getnchannels(), w.getnframes()) == (2, 4)
    got = _read(spark, f"file://{tmp_path}/w", block_seconds=1)
    assert got[0, 0] == (0, 2.0, [0.5, -0.5]) and got[1, 3] == (6, 2.0, [0.25, 0.0]) and got[1, 0][2] == [0.0, 0.0]


def test_decoded_rows_come_back(spark, tmp_path):
    from sensorline.sources import tables

    rows = [(3, 7, 1.5, "01"), (3, 8, None, None), (3, 7, 1.5, "01")]
    tables.write_decoded(spark.createDataFrame(rows, "channel long, packet long, snr double, bits string"), f"{tmp_path}/d")
    got = tables.read_decoded(spark, f"{tmp_path}/d", "snr double, bits string")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    (tmp_path / "odd.csv").write_text("key,snr\nK1,2.0\n")
    assert [tuple(r) for r in tables.read_decoded(spark, f"{tmp_path}/odd.csv", "snr double").collect()] == [(None, None, 2.0)]
