import hashlib
import zlib

import numpy as np

from palimpsest.llm import media as M


def test_round_trip(docs, empty):
    rows = M.media_digests(M.media_columns(docs)).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    assert len(rows) == len(texts)
    for doc, text in texts:
        payload = M.padded(text)
        mine = [r for r in rows if r["doc_id"] == doc]
        for r in mine:
            assert len(payload) % 64 == 0 and payload
            assert (r["n_bytes"], r["payload_bytes"]) == (len(text), len(payload))
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
            assert r["tail_crc32"] == zlib.crc32(payload[-64:])
            assert r["media_sha256"] == hashlib.sha256(M.write_wav(payload)).hexdigest()
    assert M.media_columns(empty).count() == 0


def test_blocks_of_frames_change_nothing(monkeypatch):
    payload = M.padded(bytes(np.random.default_rng(1).integers(32, 127, 40_000, dtype=np.uint8)))
    whole = M.fingerprint(payload)
    monkeypatch.setattr(M, "BLOCK", 37)
    parts = M.fingerprint(payload)
    assert len(whole[0]) > 100 and all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_a_tone_gives_its_frequency():
    t = np.arange(8192)
    tone = (128 + 100 * np.sin(2 * np.pi * 32 / M.FRAME * t)).astype(np.uint8).tobytes()
    _, f = M.peaks(tone)
    assert 32 in f and (M.fingerprint(tone)[0][1:] >= M.fingerprint(tone)[0][:-1]).all()


def plain_fingerprint(payload):
    """Frame by frame, bin by bin, with sums instead of the fast transform."""
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.float64) - 128
    n = max(1, -(-(len(samples) - M.FRAME) // M.HOP) + 1)
    samples = np.concatenate([samples, np.zeros(n * M.HOP + M.FRAME)])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(M.FRAME) / M.FRAME)
    waves = np.exp(-2j * np.pi * np.outer(np.arange(M.FRAME), np.arange(M.FRAME // 2 + 1)) / M.FRAME)
    loud = [np.abs((samples[k * M.HOP : k * M.HOP + M.FRAME] * window) @ waves) for k in range(n)]
    nothing = np.zeros(M.FRAME // 2 + 1)
    found = []
    for k in range(n):
        before, after = loud[k - 1] if k else nothing, loud[k + 1] if k + 1 < n else nothing
        own = [(-loud[k][f], f) for f in range(1, M.FRAME // 2) if loud[k][f] > loud[k][f - 1] and loud[k][f] >= loud[k][f + 1] and loud[k][f] >= before[f] and loud[k][f] >= after[f] and loud[k][f] > 1e-3]
        found += sorted((k, f) for _, f in sorted(own)[: M.PEAKS])
    pairs = []
    for i, (t, f) in enumerate(found):
        later = [(u, g) for u, g in found[i + 1 :] if u > t][: M.FAN]
        pairs += [(t, f << 16 | g << 8 | u - t) for u, g in later if u - t <= M.AHEAD]
    return sorted(pairs)


def test_fingerprint_equals_a_plain_one():
    rng = np.random.default_rng(5)
    noise = bytes(rng.integers(32, 127, 9000, dtype=np.uint8))
    for text in (b"", b"short", b"The same words again. " * 40, noise, "Ünï çødé 中文 ".encode() * 30):
        times, codes = M.fingerprint(M.padded(text))
        assert list(zip(times.tolist(), codes.tolist(), strict=True)) == plain_fingerprint(M.padded(text))
    assert len(M.fingerprint(M.padded(noise))[0]) > 100


def test_feature_of_the_stored_form(docs):
    """The digest is of the plain fingerprint of the bytes that are read back."""
    for r in M.media_digests(M.media_columns(docs.where("doc_id IN (1, 5, 10)"))).join(docs.select("doc_id", "text"), "doc_id").collect():
        pairs = plain_fingerprint(M.padded((r["text"] or "").encode()))
        packed = np.array(pairs, dtype="<i4").reshape(-1, 2).tobytes()
        assert r["feature"] == f"{len(pairs)}:{hashlib.sha256(packed).hexdigest()}"
