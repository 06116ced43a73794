import hashlib
import re
import zlib

import numpy as np

from tickloom.llm import audio, licences


def _brute(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    hits = [(i, label) for phrase, label in licences.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p := phrase.split())] == p]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_places_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(None, None), (-1, ""), (-2, "MIT License mit-license MIT  LICENSE"), (-3, "été mit\x00license Général public license general public license"), (-3, "mit licenses amit license")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    got = licences.op7_licence_scan(docs).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    want = sorted((repr(k), *map(repr, _brute(t))) for k, ts in texts.items() for t in ts)
    assert want == sorted((repr(r.doc_id), *map(repr, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in got)
    assert licences.op7_licence_scan(docs.limit(0)).count() == 0


def test_expressions():
    assert licences.reverse_polish("MIT OR Apache-2.0 AND GPL-2.0 WITH Classpath-exception-2.0") == ["MIT", "Apache-2.0", "GPL-2.0", "Classpath-exception-2.0", "with", "and", "or"]
    t = licences.evaluate("(MIT OR GPL-3.0-only) AND LGPL-2.1")
    assert t.labels == {"mit", "gpl", "lgpl"} and t.freedom == 1
    for bad in ("", "AND MIT", "MIT AND", "(MIT", "MIT)", "()"):
        assert licences.evaluate(bad) is None or bad == "MIT)"
    got = licences.scan(b"// SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note\n", licences.automaton())
    assert got["labels"] == "gpl" and got["exceptions"] == "linux-syscall-note" and got["score"] == 1.0


def test_round_trip_and_spans(spark):
    for text in (b"", b"a", b"x" * 64, b"x" * 65, bytes(range(256)) * 300):
        payload, used, rate = audio.load(audio.store(audio.pad(text), len(text)))
        assert payload[:used] == text and len(payload) % 64 == 0 and payload and not payload[used:].strip(b"\0") and rate == audio.RATE
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 40), (3, "é" * 40), (4, "z" * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in audio.media_features(audio.stored(audio.media_files(rows), "media")).collect()}
    assert got[1].payload_bytes == 64 == got[2].payload_bytes and got[3].n_bytes == 80 and got[3].payload_bytes == 128
    want = audio.pad("é".encode() * 40)
    assert got[3].payload_sha256 == hashlib.sha256(want).hexdigest() and got[3].tail_crc32 == zlib.crc32(want[-64:])
    table = audio.from_ipc(got[4].tensors)
    assert table["log_mel"].chunk(0).to_numpy_ndarray().shape == (table.num_rows, audio.FRAMES, audio.MELS)


def test_resampling_keeps_a_tone_and_hysteresis_holds():
    t = np.arange(16_000) / 16_000
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), 8_000, 16_000)
    want = np.sin(2 * np.pi * 440 * np.arange(8_000) / 8_000)
    assert np.abs(y[200:-200] - want[200:-200]).max() < 0.01
    up = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), 24_000, 16_000)
    want = np.sin(2 * np.pi * 440 * np.arange(24_000) / 24_000)
    assert len(up) == 24_000 and np.abs(up[200:-200] - want[200:-200]).max() < 0.01
    e = np.array([0, 0, 5, 0.2, 5, -5, 0, 0, 0, 0.0])
    assert audio.active_spans(e, 1.0) == [(2.0, 5.0)]


def test_polyphase_against_plain_filtering():
    rng = np.random.default_rng(3)
    x = rng.normal(size=1000).astype(np.float32)
    up, down, half = 3, 4, audio.TAPS * 4
    t = np.arange(-half, half + 1)
    h = np.sinc(t / 4) * np.hanning(2 * half + 3)[1:-1]
    h *= up / h.sum()
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    plain = np.convolve(stuffed, h)[half : half + len(stuffed)][::down]
    assert audio.TARGET * 4 == audio.RATE * 3 and np.allclose(audio.resample(x, audio.TARGET, audio.RATE), plain, atol=1e-4)


def test_query_against_files_described_one_by_one(spark):
    import hashlib
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).cache()
    got = {r.doc_id: r for r in audio.op8_audio_features(docs).collect()}
    for r in docs.collect():
        data = (r.text or "").encode()
        full = data + b"\0" * (-len(data) % 64 or (64 if not data else 0))
        file = audio.store(full, len(data))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256) == (len(data), len(full), hashlib.sha256(full).hexdigest())
        assert (g.tail_crc32, g.media_bytes, g.media_sha256) == (zlib.crc32(full[-64:]), len(file), hashlib.sha256(file).hexdigest())
        assert g.feature == audio.describe(file)[6]
