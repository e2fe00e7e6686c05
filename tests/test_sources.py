import hashlib
import io
import json
import os
import struct
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.sources import files, riff, tree
from lectern.streaming import events as E


def _wav(path, samples, rate=8000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(struct.pack(f"<{len(samples)}h", *samples))


def test_texts_and_inventory(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo é")
    (tmp_path / "b.json").write_text('{"x": 1}')
    (tmp_path / "c.bin").write_bytes(b"\0\1")
    got = files.texts(spark, str(tmp_path / "a.txt")).collect()
    assert [(r.text, r.text_sha) for r in got] == [("one\ntwo é", hashlib.sha256("one\ntwo é".encode()).hexdigest())]
    kinds = {r.path[-5:]: (r.kind, r.bytes) for r in files.inventory(spark, str(tmp_path)).collect()}
    assert kinds == {"a.txt": ("text", 10), ".json": ("data", 8), "c.bin": ("other", 2)}
    sums = {r.sha256 for r in files.digests(spark, str(tmp_path), "*.bin").collect()}
    assert sums == {hashlib.sha256(b"\0\1").hexdigest()}


def test_json_round_trip(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"id": 1, "tags": ["a"]}, {"id": 2, "more": 3}], indent=2))
    rows = files.json_documents(spark, str(tmp_path / "d.json"), "id long, tags array<string>")
    assert sorted((r.id, r.tags) for r in rows.collect()) == [(1, ["a"]), (2, None)]
    files.write_json_lines(rows.coalesce(1), str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["id"]) == [{"id": 1, "tags": ["a"]}, {"id": 2, "tags": None}]


def test_concat_list(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# head\nfile 'a b.wav'\n\nfile 'c.wav'\n")
    assert [(r.position, r.file) for r in files.concat_list(spark, str(tmp_path / "l.txt")).orderBy("position").collect()] == [(2, "a b.wav"), (4, "c.wav")]
    (tmp_path / "m.txt").write_text("file 'a'\nnonsense\n")
    with pytest.raises(Exception, match="no concat line"):
        files.concat_list(spark, str(tmp_path / "m.txt")).collect()


def test_audio_levels(spark, tmp_path):
    _wav(tmp_path / "x.wav", [0] * 160 + [16384, -16384] * 400 + [8192] * 160)
    _wav(tmp_path / "empty.wav", [])
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.audio_levels(spark, str(tmp_path)).collect()}
    x = got["x.wav"]
    assert (x.seconds, x.peak, x.head_peak, x.tail_peak, x.error) == (0.14, 0.5, 0.0, 0.25, None)
    assert abs(x.rms - np.sqrt((800 * 0.25 + 160 * 0.0625) / 1120)) < 1e-12
    assert got["empty.wav"].seconds == 0 and got["bad.wav"].error


def _chunk(name, data):
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def _riff(code, bits, x, channels=1, extensible=False, kind=b"RIFF", odd=False):
    """A file of samples from -1 to 1 in a format."""
    x = np.repeat(np.asarray(x, float)[:, None], channels, 1)
    if code == 3:
        data = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        data = (x * 128 + 128).clip(0, 255).astype(np.uint8).tobytes()
    else:
        whole = (x * (1 << (bits - 1))).clip(-(1 << (bits - 1)), (1 << (bits - 1)) - 1).astype("<i4")
        data = whole.tobytes() if bits == 32 else whole.astype("<i2").tobytes() if bits == 16 else whole.reshape(-1, 1).view(np.uint8)[:, :3].tobytes()
    align = channels * bits // 8
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else code, channels, 8000, 8000 * align, align, bits)
    form += struct.pack("<HHIH14s", 22, bits, 0, code, bytes(14)) if extensible else b""
    body = b"WAVE" + (_chunk(b"ds64", struct.pack("<QQQI", 0, len(data), 0, 0)) if kind == b"RF64" else b"") + (_chunk(b"LIST", b"odd") if odd else b"") + _chunk(b"fmt ", form) + _chunk(b"fact", b"\0" * 4)
    size = struct.pack("<I", 0xFFFFFFFF if kind == b"RF64" else len(data))
    return kind + struct.pack("<I", 0xFFFFFFFF if kind == b"RF64" else len(body)) + body + b"data" + size + data + b"\0" * (len(data) % 2) + _chunk(b"LIST", b"tail")


FORMATS = [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)]


@pytest.mark.parametrize("code,bits", FORMATS)
@pytest.mark.parametrize("channels,extensible,kind,odd", [(1, False, b"RIFF", False), (2, True, b"RIFF", True), (3, False, b"RF64", True)])
def test_every_sample_format(code, bits, channels, extensible, kind, odd):
    x = np.sin(np.arange(1001) / 7) * 0.75
    form, blocks = riff.walk(io.BytesIO(_riff(code, bits, x, channels, extensible, kind, odd)), block=100)
    parts = list(blocks)
    assert (form.bits, form.channels, form.rate) == (bits, channels, 8000) and max(map(len, parts)) == 100
    assert np.abs(np.concatenate(parts) - x).max() < (1 / 64 if bits == 8 else 1e-4)


def test_bad_sound():
    good = _riff(1, 16, [0.5] * 10)
    for bad in (b"", b"RIFF", good[:-30], good.replace(b"WAVE", b"WAVY"), good.replace(b"fmt ", b"fmx "), _riff(1, 16, [0.1]).replace(struct.pack("<HH", 1, 1), struct.pack("<HH", 7, 1), 1)):
        with pytest.raises(riff.RiffError):
            list(riff.walk(io.BytesIO(bad))[1])


def test_levels_in_blocks():
    x = np.random.default_rng(1).normal(0, 0.2, 5000)
    for width in (1, 7, 160, 5000):
        levels = riff.Levels(160)
        for at in range(0, len(x), width):
            levels.add(x[at : at + width])
        assert (levels.n, levels.peak, levels.head, levels.tail_peak) == (5000, np.abs(x).max(), np.abs(x[:160]).max(), np.abs(x[-160:]).max()) and abs(levels.rms - np.sqrt((x**2).mean())) < 1e-9


def test_sound_files_of_all_formats(spark, tmp_path):
    for code, bits in FORMATS:
        (tmp_path / f"{code}-{bits}.wav").write_bytes(_riff(code, bits, [0.5, -0.25] * 400, 2, odd=True))
    got = files.audio_levels(spark, str(tmp_path)).collect()
    assert len(got) == 6 and all(r.error is None and r.seconds == 0.1 and r.peak == 0.5 and r.tail_peak == 0.5 for r in got)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "root"
    for k in range(12):
        (root / f"d{k % 4}" / f"e{k}").mkdir(parents=True)
        (root / f"d{k % 4}" / f"e{k}" / f"f{k}.WAV").write_bytes(b"x" * k)
    (root / "top.json").write_text("{}")
    (root / "Z.txt").write_text("zz")
    (root / "skip.bin").write_bytes(b"1")
    (root / "link.txt").symlink_to(root / "Z.txt")
    (root / "loop").symlink_to(root)
    os.utime(root / "Z.txt", ns=(0, 0))
    return root


@pytest.mark.parametrize("parts", [1, 3, 8, 100])
def test_entries_of_a_tree(spark, folder, parts):
    got = {(r.path, r.type) for r in tree.entries(spark, str(folder), parts=parts).collect()}
    want = {(p.relative_to(folder).as_posix(), "link" if p.is_symlink() else "folder" if p.is_dir() else "file") for p in folder.rglob("*") if "loop/" not in p.as_posix()}
    assert got == want and tree.entries(spark, str(folder), parts=parts).count() == len(want)


def test_inventory_is_whole_or_refused(spark, folder):
    held, about = tree.inventory(spark, str(folder), most=14)
    first = about.first()
    assert (first.n_files, first.n_bytes, first.kinds) == (14, sum(range(12)) + 4, {"audio": 12, "data": 1, "text": 1})
    assert held.where("path = 'd3/e11/f11.WAV' and bytes = 11 and kind = 'audio'").count() == 1
    assert tree.inventory(spark, str(folder), expected=first.fingerprint.upper())[1].first() == first
    with pytest.raises(tree.ScanError, match="SCAN_LIMIT_EXCEEDED"):
        tree.inventory(spark, str(folder), most=13)
    (folder / "Z.txt").write_text("zzz")
    with pytest.raises(tree.ScanError, match="METADATA_FINGERPRINT_CHANGED"):
        tree.inventory(spark, str(folder), expected=first.fingerprint)
    for bad in (folder / "loop", folder / "none", folder / "Z.txt"):
        with pytest.raises(Exception, match="ROOT_NOT_LOCAL_DIRECTORY"):
            tree.entries(spark, str(bad)).collect()
    empty = folder / "d0" / "empty"
    empty.mkdir()
    assert tuple(tree.inventory(spark, str(empty))[1].first())[:3] == (0, 0, {})


def test_unreadable_folder_fails_the_scan(spark, folder, monkeypatch):
    def refused(path):
        raise PermissionError(path)

    reader = tree.TreeReader(str(folder), True, 2)
    part = reader.partitions()[0]
    monkeypatch.setattr(os, "scandir", refused)
    with pytest.raises(tree.ScanError, match="DIRECTORY_SCAN_FAILED"):
        list(reader.read(part))


def test_storage_of_the_top_level(spark, folder):
    now = time.time_ns()
    r = tree.storage(spark, str(folder), now).first()
    assert tuple(r) == (3, 5, 1, 2, 4, 2, False)
    leaf = tree.storage(spark, str(folder / "d3" / "e11"), now).first()
    assert tuple(leaf) == (1, 11, 0, 0, 0, 0, True)
    with pytest.raises(tree.ScanError, match="FILE_BUDGET_EXCEEDED"):
        tree.storage(spark, str(folder), now, most=2)


def test_report_is_ordered(spark, tmp_path):
    files.write_report(spark.range(100).repartition(4), str(tmp_path / "r"), F.format_string("row %d", F.col("id")), ["id"])
    lines = [x for f in sorted((tmp_path / "r").glob("part*")) for x in f.read_text().splitlines()]
    assert lines == [f"row {i}" for i in range(100)]


def test_stream_in_several_batches_is_the_batch(spark, tmp_path):
    from tests.oracle import SF

    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartition(5).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    got = E.settle(E.tumbling(stream, "6 hours", ["event_type"]), ["start_s", "event_type"], "t")
    want = E.tumbling(rows, "6 hours", ["event_type"])
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    got = E.settle(E.retries(stream.where("event_type = 'error'")), ["user_id"], "r")
    want = rows.where("event_type = 'error'").groupBy("user_id").agg(F.least(F.count("*"), F.lit(2)).alias("queued"), (F.count("*") - F.least(F.count("*"), F.lit(2))).alias("exhausted"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
