"""Chroma fingerprints: decoding, invariances, alignment against trying every offset."""

import io
import random
import wave

import numpy as np
import pytest

from larkmill.llm import audio


def tune(seed, notes=40, rate=audio.RATE):
    rng = random.Random(seed)
    return audio.melody([rng.uniform(-0.6, 0.6) for _ in range(notes)], rate=rate)


def samples(blob):
    return audio.decode(blob)[0]


def test_round_trip_of_wav():
    sound = np.sin(np.arange(5000) / 7) * 0.5
    back, rate = audio.decode(audio.wav(sound))
    assert rate == audio.RATE and np.abs(back - sound).max() < 1e-3
    out = io.BytesIO()
    with wave.open(out, "wb") as sink:  # stereo, 8 bits
        sink.setparams((2, 1, 8000, 0, "NONE", ""))
        sink.writeframes(bytes([128, 255] * 100))
    back, rate = audio.decode(out.getvalue())
    assert rate == 8000 and len(back) == 100 and abs(back[0] - 127 / 256) < 1e-6
    out = io.BytesIO()
    with wave.open(out, "wb") as sink:  # 24 bits
        sink.setparams((1, 3, audio.RATE, 0, "NONE", ""))
        sink.writeframes(b"".join(int(x * 8388607).to_bytes(3, "little", signed=True) for x in sound))
    assert np.abs(audio.decode(out.getvalue())[0] - sound).max() < 1e-6
    for bad in (None, b"", b"RIFF", b"nonsense" * 10, audio.wav(sound)[:30]):
        assert len(audio.fingerprint(bad)[0]) == 0


def test_areas_are_sums():
    frames = audio.chroma(samples(tune(1)))
    packed, sound = audio.integers(frames)
    assert len(packed) == len(frames) - audio.SPAN + 1 and sound.all()
    kind, y, height, width = audio.FILTERS[8]
    for t in (0, 5, 17):  # the filter that halves an area by time, by plain sums
        plus, minus = frames[t + width // 2 : t + width, y : y + height].sum(), frames[t : t + width // 2, y : y + height].sum()
        value = (plus - minus) / (plus + minus + 1e-9)
        code = int(value > -audio.STEP) + int(value > 0) + int(value > audio.STEP)
        assert int(packed[t]) >> (2 * (15 - 8)) & 3 == code ^ (code >> 1)


def queries(*blobs):
    prints = [audio.fingerprint(b) for b in blobs]
    return audio.Queries([(p.tobytes(), s.tobytes(), [k], 1) for k, (p, s) in enumerate(prints)])


def test_alignment_finds_the_same_recording():
    whole, held = samples(tune(3)), queries(tune(3), tune(4), tune(5))
    rng = np.random.default_rng(0)
    changed = {
        "same": whole,
        "quieter": whole * 0.2,
        "noisy": whole + rng.normal(0, 0.03, len(whole)),
        "cut": whole[12 * audio.HOP :],
        "later": np.concatenate([np.zeros(9 * audio.HOP), whole]),
    }
    for name, sound in changed.items():
        found = list(held.aligned(*audio.fingerprint(audio.wav(sound))))
        assert [e for e, _, _ in found] == [0], name
        assert found[0][1] == {"cut": 12, "later": -9}.get(name, 0), name
    faster = audio.wav(np.interp(np.arange(0, len(whole) - 1, audio.RATE / 11025), np.arange(len(whole)), whole), 11025)
    assert [e for e, _, _ in held.aligned(*audio.fingerprint(faster))] == [0]
    assert list(held.aligned(*audio.fingerprint(audio.wav(np.zeros(40000))))) == []


def test_bits_and_seeds():
    one = np.array([1, 2, 3, 3, 3, 4], np.uint32)
    assert audio.seeds(one, np.ones(6, bool)).tolist() == [0, 1, 2, 5]
    assert audio.bit_error(one, one, 0) == (0.0, 6) and audio.bit_error(one, one[2:], 2) == (0.0, 4)
    assert audio.bit_error(one, one, 9) == (1.0, 0)


@pytest.mark.parametrize("block", [4096, 3])
def test_query_against_every_offset(spark, block):
    rng = random.Random(8)
    base = samples(tune(100))
    blobs = {i: tune(i) for i in range(30)}
    for i in (20, 40, 41, 60, 61, 62):
        blobs[i] = audio.wav(np.concatenate([np.zeros(rng.randrange(4) * audio.HOP), base + np.random.default_rng(i).normal(0, 0.02, len(base))]))
    blobs |= {80: tune(7), 81: tune(7), 100: tune(7), 200: None, 201: b"junk", 220: b""}
    rows = spark.createDataFrame([(i, bytearray(b) if b is not None else None, "x") for i, b in blobs.items()] + [(None, bytearray(tune(7)), "x")], "recording_id long, audio binary, prints string")
    got = {r["vec_id"]: r for r in audio.digest(audio.align(audio.fingerprints(rows), block=block)).collect()}
    prints = {i: audio.fingerprint(b)[0] for i, b in blobs.items()}
    for i, own in prints.items():
        want = []
        for q in (q for q in blobs if q % 20 == 0 and q != i and len(prints[q])):
            tried = [(audio.bit_error(prints[q], own, k), k) for k in range(-len(own), len(prints[q]))]
            tried = [(e, k) for (e, n), k in tried if n >= audio.LEAST_OVERLAP]
            if tried and min(tried)[0] <= 0.2:
                want.append((min(tried)[0], q))
        assert got[i]["n_matches"] == len(want), i
        if want:
            assert (got[i]["best_match"], round(got[i]["best_error"], 9)) == (min(want)[1], round(min(want)[0], 9))
    assert got[None]["n_matches"] == 2 and got[200]["n_prints"] == 0
    assert audio.align(audio.fingerprints(rows.limit(0))).count() == 0


def test_least_two_ids_of_each_kind(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 1, 5, 255, 256, 1 << 40, -3, -256, (1 << 63) - 1, -(1 << 63)]) if k % 3 else rng.getrandbits(62), bytes([k % 7]), b"s") for k in range(300)]
    rows += [(9, b"one", b"s")] * 3 + [(n, b"many", b"s") for n in range(0, 6000, 20)]
    got = {bytes(r["prints"]): (r["ids"], r["n"]) for r in audio._kinds(spark.createDataFrame(rows, "audio_id long, prints binary, sound binary")).collect()}
    want = {p: [i for i, q, _ in rows if q == p] for _, p, _ in rows}
    assert got == {p: (sorted(set(ids))[:2], len(ids)) for p, ids in want.items()}


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    rows = spark.createDataFrame([(i, bytearray(tune(i % 6))) for i in range(0, 200, 10)], "recording_id long, audio binary")
    whole = sorted(map(tuple, audio.digest(audio.align(audio.fingerprints(rows))).collect()))
    monkeypatch.setattr(audio, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, audio.digest(audio.align(audio.fingerprints(rows))).collect())) == whole
