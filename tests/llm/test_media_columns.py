import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import functions as F

from cartulary.llm import media_columns as M
from cartulary.llm.queries import QUERIES


def tone(hz, n, rate=M.RATE):
    return (128 + 100 * np.sin(2 * np.pi * hz * np.arange(n) / rate)).astype(np.uint8)


def test_round_trip():
    for data in (b"", b"x", b"y" * 576, b"z" * 577, bytes(range(256)) * 9):
        media = M.to_wav(data)
        with wave.open(io.BytesIO(media)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, M.RATE)
        back = M.from_wav(media)
        assert len(back) % 576 == 0 and len(back) == max(1, -(-len(data) // 576)) * 576
        assert back == data.ljust(len(back), b"\xff")


def test_peaks_stand_at_the_tone():
    x = np.concatenate([tone(1000, 2880), tone(2500, 2880)])
    frame, bin_ = M.peaks(x)
    hz = bin_ * M.RATE / M.WINDOW
    assert np.isin(np.round(hz[frame < 30], -2), [1000]).any() and np.isin(np.round(hz[frame > 50], -2), [2500]).any()


def test_points_are_sorted_time_coded_and_blockwise_equal(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.integers(30, 120, 576 * 40).astype(np.uint8)
    found = M.points(x)
    assert len(found) and (np.diff(found) >= 0).all()
    time, apart = found >> 32, found & 0xFF
    assert time.max() <= len(x) // M.HOP and apart.max() <= M.SPAN
    brute = set()
    f, b = M.peaks(x)
    for i in range(len(f)):
        for j in range(i + 1, min(i + 1 + M.FAN, len(f))):
            if f[j] - f[i] <= M.SPAN:
                brute.add(int(f[i]) << 32 | int(b[i]) << 20 | int(b[j]) << 8 | int(f[j] - f[i]))
    assert set(found.tolist()) == brute
    monkeypatch.setattr(M, "BLOCK", 7)
    assert (M.points(x) == found).all()


def test_silence_has_no_points():
    assert len(M.points(np.full(576, 255, np.uint8))) == 0


def test_rows(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in df.select("doc_id", M.media_column(F.col("text")).alias("m")).select("doc_id", "m", M.media_features(F.col("m")).alias("f")).collect()}
    assert got[1]["m"] == got[2]["m"] and got[1]["f"] == got[2]["f"] and got[3]["m"] == got[4]["m"]
    assert got[3]["f"]["payload_bytes"] == 576


def test_whole_table(spark, sf):
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op4_media_columns"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r["doc_id"]]
        payload = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        media = M.to_wav(data)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(data), len(payload), len(media))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(media).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["feature"].split(":")[0] == str(len(M.points(np.frombuffer(payload, np.uint8))))


def test_null_media_has_null_features(spark):
    found = spark.createDataFrame([(1, None)], "doc_id long, media binary").select(M.media_features("media").alias("f")).select("f.*").first()
    assert list(found) == [None] * 4
