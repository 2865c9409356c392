"""Ranged reads of WAV files against the standard library, and what they read."""

import struct
import wave

import numpy as np
import pytest

from timeloom.sources import wav


def write(path, n, rate=16000, channels=1, width=2, before=b""):
    samples = (np.arange(n) * 7919 % 65536 - 32768).astype("<i2")
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(samples.tobytes() if width == 2 else bytes(n))
    if before:  # another part, of odd length, before the samples
        raw = path.read_bytes()
        path.write_bytes(raw[:36] + b"LIST" + struct.pack("<I", len(before)) + before + b"\0" * (len(before) & 1) + raw[36:])
    return samples.astype("f4") / np.float32(32768)


def test_spans(spark, tmp_path):
    a, b = tmp_path / "a.wav", tmp_path / "b b.wav"
    x, y = write(a, 16 * 1000 + 5), write(b, 320, before=b"odd")
    spans = [(str(a), s, e) for s, e in ((0, 10), (5, 5), (990, 5000), (-50, 3), (7, 2), (5000, 6000), (0, 1001))] + [(f"file://{a}", 1, 2), (str(b), 0, 20)]
    got = wav.wav_slices(spark.createDataFrame(spans, "path string, start_ms bigint, end_ms bigint").repartition(3)).collect()
    assert len(got) == len(spans)
    for r in got:
        whole = y if "b b" in r.path else x
        assert r.error is None and r.samples == whole[max(r.start_ms, 0) * 16 : max(r.end_ms, 0) * 16].tolist()


def test_odd_files(spark, tmp_path):
    p = lambda name: tmp_path / name
    x = write(p("whole"), 1600)
    raw = p("whole").read_bytes()
    p("cut").write_bytes(raw[: 44 + 1001])  # ends in half a sample
    p("pipe").write_bytes(raw[:40] + b"\xff\xff\xff\xff" + raw[44:])
    p("large").write_bytes(b"RF64" + raw[4:40] + b"\xff\xff\xff\xff" + raw[44:])
    p("wide").write_bytes(raw[:16] + struct.pack("<I", 40) + struct.pack("<H", 0xFFFE) + raw[22:36] + struct.pack("<HHI", 22, 16, 0) + struct.pack("<H", 1) + bytes(14) + raw[36:])
    p("empty").write_bytes(b""), p("text").write_text("no sound at all, but long enough"), p("headless").write_bytes(raw[:12] + raw[36:]), p("silent").write_bytes(raw[:36])
    write(p("stereo"), 100, channels=2), write(p("slow"), 100, rate=8000), write(p("thin"), 100, width=1)
    names = ["whole", "cut", "pipe", "large", "wide", "empty", "text", "headless", "silent", "stereo", "slow", "thin", "missing"]
    rows = [(str(p(n)), 0, 1000) for n in names] + [(None, 0, 1), (str(p("whole")), None, 1)]
    got = wav.wav_slices(spark.createDataFrame(rows, "path string, start_ms bigint, end_ms bigint")).collect()
    for r in got[:5]:
        n = 500 if r.path.endswith("cut") else 1600
        assert r.error is None and r.samples == x[:n].tolist(), r.path
    assert all(r.error and r.samples is None for r in got[5:])


class Counted:
    """An Arrow file that notes what is read of it."""

    def __init__(self, f, log):
        self.f, self.log = f, log

    def __enter__(self):
        return self

    def __exit__(self, *a):
        self.f.close()

    def size(self):
        return self.f.size()

    def read_at(self, n, at):
        self.log.append(n)
        return self.f.read_at(n, at)


def test_only_the_slice_is_read(tmp_path, monkeypatch):
    path, log = tmp_path / "two-hours.wav", []
    raw = write(tmp_path / "x", 16) is not None and (tmp_path / "x").read_bytes()
    hours = 2 * 3600 * 16000 * 2
    with path.open("wb") as f:  # a sparse file: silence of two hours
        f.write(raw[:40] + struct.pack("<I", hours))
        f.truncate(44 + hours)

    class Files:
        def open_input_file(self, where):
            return Counted(wav.pf.LocalFileSystem().open_input_file(where), log)

    monkeypatch.setattr(wav, "file_system", lambda p: (Files(), p))
    assert len(wav.read_span(str(path), 3_600_000, 3_605_000)) == 80_000
    assert sum(log) == 160_000 + 12 + 8 + 16 + 8
    reader = wav.WavReader({"path": str(path), "chunk_ms": "300000", "pad_ms": "5000"})
    log.clear()
    parts = reader.partitions()
    assert len(parts) == 24 and sum(log) == 44
    assert [(c.start_ms, c.end_ms) for c in (parts[0], parts[1], parts[-1])] == [(0, 305_000), (295_000, 605_000), (6_895_000, 7_200_000)]
    log.clear()
    assert len(next(reader.read(parts[1]))[4]) == 310_000 * 16 and sum(log) == 310_000 * 32 + 44


def test_source(spark, tmp_path):
    wav.register(spark)
    (tmp_path / "v").mkdir()
    x, _ = write(tmp_path / "v" / "a.wav", 16 * 95 + 3), write(tmp_path / "v" / "z.wav", 0)
    (tmp_path / "v" / "bad.wav").write_text("x")
    (tmp_path / "v" / "note.txt").write_text("x")
    load = lambda path, **o: spark.read.format("wav").options(**o).load(path)
    d = load(str(tmp_path / "*" / "*.wav"), chunk_ms=40, pad_ms=10)
    got = sorted(d.collect(), key=lambda r: (r.path, r.chunk))
    assert d.rdd.getNumPartitions() == 5
    assert [(r.path[-5:], r.chunk, r.start_ms, r.end_ms) for r in got] == [("a.wav", 0, 0, 50), ("a.wav", 1, 30, 90), ("a.wav", 2, 70, 96), ("d.wav", 0, 0, 0), ("z.wav", 0, 0, 0)]
    assert all(r.samples == x[r.start_ms * 16 : r.end_ms * 16].tolist() for r in got[:3])
    assert got[3].error and got[3].samples is None and got[4].samples == [] and got[4].error is None
    assert load(str(tmp_path / "v" / "a.wav")).count() == 1 and load(str(tmp_path / "none" / "*.wav")).count() == 0
    with pytest.raises(Exception, match="length"):
        load(str(tmp_path / "v" / "a.wav"), chunk_ms=0).collect()
