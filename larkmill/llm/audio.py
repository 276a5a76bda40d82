"""Chroma fingerprints of recordings in a binary column, and their alignment.

A recording (WAV, PCM) is mixed down, brought to one sample rate and cut into overlapping
frames, whose spectral power is summed by pitch class. Over the integral image of these
twelve-row frames, sixteen rectangle filters compare sums of areas; each result is quantized
to two Gray-coded bits, so every frame gives one 32-bit integer. Two recordings are aligned
by the histogram of offsets between their equal integers; the share of differing bits at the
fullest offset decides whether they are the same.

Stated queries are compared with all recordings: distinct query fingerprints are broadcast in
blocks of bounded size, and each recording is looked up where it is stored. No shuffle meets
a frequent integer, and a group of equal recordings is one entry with a number.
"""

from __future__ import annotations

import io
import uuid
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, parts, prepare

RATE = 5512
FRAME, HOP = 1024, 344
CLASSES = 12
LOWEST, HIGHEST = 65.0, 2000.0
#: (kind, first pitch class, classes, frames): kind 0 sums the area, 1 halves it by class, 2 by time, 3 in quarters, 4 in thirds by class, 5 by time.
FILTERS = ((0, 0, 3, 12), (0, 3, 3, 12), (0, 6, 3, 12), (0, 9, 3, 12), (1, 0, 4, 9), (1, 4, 4, 9), (1, 8, 4, 9), (1, 0, 12, 6), (2, 0, 4, 10), (2, 4, 4, 10), (2, 8, 4, 10), (3, 0, 6, 8), (3, 6, 6, 8), (3, 2, 8, 12), (4, 0, 12, 9), (5, 0, 12, 12))
SPAN = max(f[3] for f in FILTERS)
STEP = 0.12
#: Frames that must overlap, and the largest share of differing bits.
LEAST_OVERLAP, MOST_ERROR = 20, 0.3
LEAST_VOTES = 2
#: Distinct query fingerprints that are broadcast at once.
BLOCK_QUERIES = 4096
#: Bytes of their integers and marks, of which a block holds about as many at most.
BLOCK_BYTES = 16 << 20


def decode(blob: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and their rate; nothing for null, empty or unreadable bytes."""
    try:
        with wave.open(io.BytesIO(blob or b"")) as source:
            channels, width, rate, n = source.getnchannels(), source.getsampwidth(), source.getframerate(), source.getnframes()
            raw = source.readframes(n)
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0), RATE
    kind = {1: np.uint8, 2: "<i2", 3: "<i4", 4: "<i4"}.get(width)
    if kind is None or not channels or not rate:
        return np.zeros(0), RATE
    raw = raw[: len(raw) - len(raw) % (width * channels)]
    if width == 3:  # the three bytes are the upper ones of four
        four = np.zeros((len(raw) // 3, 4), np.uint8)
        four[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        raw, width = four.tobytes(), 4
    samples = np.frombuffer(raw, kind).astype(np.float64)
    samples = (samples - 128) / 128 if width == 1 else samples / float(1 << (8 * width - 1))
    return samples.reshape(-1, channels).mean(axis=1), rate


def resampled(samples: np.ndarray, rate: int) -> np.ndarray:
    if rate == RATE or not len(samples):
        return samples
    step = rate / RATE
    if step >= 2:  # a moving mean keeps high tones from folding down
        size = int(step)
        sums = np.concatenate([[0.0], np.cumsum(samples)])
        samples = (sums[size:] - sums[:-size]) / size
    at = np.arange(0, len(samples) - 1, step)
    return np.interp(at, np.arange(len(samples)), samples)


_WINDOW = np.hanning(FRAME)
_FREQUENCY = np.fft.rfftfreq(FRAME, 1 / RATE)
_USED = np.flatnonzero((_FREQUENCY >= LOWEST) & (_FREQUENCY <= HIGHEST))
_TO_CLASS = np.zeros((len(_USED), CLASSES))
_TO_CLASS[np.arange(len(_USED)), np.rint(12 * np.log2(_FREQUENCY[_USED] / 440.0)).astype(int) % CLASSES] = 1


def chroma(samples: np.ndarray) -> np.ndarray:
    """Power by pitch class of every frame, each frame of length 1 (silent ones 0)."""
    n = (len(samples) - FRAME) // HOP + 1 if len(samples) >= FRAME else 0
    out = np.zeros((n, CLASSES))
    for a in range(0, n, 4096):
        rows = np.arange(a, min(n, a + 4096))
        frames = samples[rows[:, None] * HOP + np.arange(FRAME)] * _WINDOW
        power = np.abs(np.fft.rfft(frames, axis=1)[:, _USED]) ** 2
        out[rows] = power @ _TO_CLASS
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(length > 1e-9, out / np.maximum(length, 1e-12), 0)


def integers(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A packed integer for each frame that has SPAN - 1 others after it, and whether there is sound in them."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    image = np.zeros((len(frames) + 1, CLASSES + 1))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0, t1, y0, y1):
        return image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]

    packed = np.zeros(n, np.uint32)
    for kind, y, height, width in FILTERS:
        end, middle, third = y + height, y + height // 2, height // 3
        half, part = width // 2, width // 3
        whole = area(0, width, y, end)
        if kind == 0:
            plus, minus = whole, area(0, width, 0, CLASSES) * height / CLASSES
        elif kind == 1:
            plus, minus = area(0, width, middle, end), area(0, width, y, middle)
        elif kind == 2:
            plus, minus = area(half, width, y, end), area(0, half, y, end)
        elif kind == 3:
            plus = area(half, width, y, middle) + area(0, half, middle, end)
            minus = whole - plus
        elif kind == 4:
            plus = area(0, width, y + third, y + 2 * third) * 2
            minus = whole - plus / 2
        else:
            plus = area(part, 2 * part, y, end) * 2
            minus = whole - plus / 2
        value = (plus - minus) / (np.abs(plus) + np.abs(minus) + 1e-9)
        code = (value > -STEP).astype(np.uint32) + (value > 0) + (value > STEP)
        packed = (packed << np.uint32(2)) | (code ^ (code >> np.uint32(1))).astype(np.uint32)
    return packed, area(0, SPAN, 0, CLASSES) > 1e-6


def fingerprint(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    return integers(chroma(resampled(*decode(blob))))


def seeds(packed: np.ndarray, sound: np.ndarray) -> np.ndarray:
    """Positions that vote: with sound, and the first of each run of equal integers."""
    fresh = np.ones(len(packed), bool)
    fresh[1:] = packed[1:] != packed[:-1]
    return np.flatnonzero(fresh & sound)


def bit_error(one: np.ndarray, two: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits where ``one`` shifted by ``offset`` meets ``two``, and how many integers meet."""
    a, b = max(0, offset), min(len(one), len(two) + offset)
    if b <= a:
        return 1.0, 0
    return float(np.bitwise_count(one[a:b] ^ two[a - offset : b - offset]).sum()) / (32 * (b - a)), b - a


class Queries:
    """Distinct query fingerprints: their voting integers in one sorted list."""

    def __init__(self, entries):
        self.entries = entries  # (integers, sound, least two ids, number)
        self.packed = [np.frombuffer(e[0], np.uint32) for e in entries]
        marks = [seeds(p, np.frombuffer(e[1], bool)) for p, e in zip(self.packed, entries)]
        value = np.concatenate([p[m] for p, m in zip(self.packed, marks)] or [np.zeros(0, np.uint32)])
        order = np.argsort(value, kind="stable")
        self.value = value[order]
        self.owner = np.repeat(np.arange(len(entries)), [len(m) for m in marks])[order]
        self.at = np.concatenate([*marks, np.zeros(0, np.int64)])[order].astype(np.int64)

    def aligned(self, packed: np.ndarray, sound: np.ndarray):
        """(entry, offset, error) of every query that aligns: at its fullest offset."""
        mine = seeds(packed, sound)
        low, high = np.searchsorted(self.value, packed[mine]), np.searchsorted(self.value, packed[mine], side="right")
        n = high - low
        if not n.sum():
            return
        votes: dict[int, int] = {}
        ends = np.cumsum(n)
        for a in range(0, len(mine), 64):  # votes of a few positions at a time
            b = min(len(mine), a + 64)
            first = ends[a - 1] if a else 0
            row = np.repeat(np.arange(a, b), n[a:b])
            k = low[row] + np.arange(len(row)) + first - (ends[row] - n[row])
            key, count = np.unique((self.owner[k] << 32) + (self.at[k] - mine[row] + (1 << 31)), return_counts=True)
            for x, c in zip(key.tolist(), count.tolist()):
                votes[x] = votes.get(x, 0) + c
        best: dict[int, tuple[int, int]] = {}
        for x, c in votes.items():
            entry, offset = x >> 32, (x & 0xFFFFFFFF) - (1 << 31)
            if c >= LEAST_VOTES and (c, -abs(offset), -offset) > best.get(entry, (0, -(1 << 40), 0)):
                best[entry] = (c, -abs(offset), -offset)
        for entry, (_, _, offset) in sorted(best.items()):
            error, overlap = bit_error(self.packed[entry], packed, -offset)
            if overlap >= LEAST_OVERLAP and error <= MOST_ERROR:
                yield entry, -offset, error


_PRINTS = "audio_id long, prints binary, sound binary"


def fingerprints(recordings: DataFrame, *, recording_id="recording_id", audio="audio") -> DataFrame:
    """``audio_id, prints, sound``: packed 32-bit integers (little-endian) and a byte for each that tells sound."""
    prepare(recordings.sparkSession)

    def run(batches):
        for batch in parts(batches, 1):
            rows = [fingerprint(b) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.astype("<u4").tobytes() for p, _ in rows], pa.binary()), pa.array([s.tobytes() for _, s in rows], pa.binary())], ["audio_id", "prints", "sound"])

    return recordings.select(F.col(recording_id).cast("long").alias("audio_id"), F.col(audio).cast("binary").alias("audio")).mapInArrow(run, _PRINTS)


def _kinds(asked: DataFrame) -> DataFrame:
    """``prints, sound, ids, n`` of each distinct fingerprint: its least two ids and its number of rows.

    The ids of a group are never gathered: each of an id's eight bytes puts it into one of 256
    classes, whose least ids are kept. The second least id differs from the least in some byte,
    so it is the least of its class there: the least two are among these 2,048 at most.
    """
    byte = F.posexplode(F.array([F.shiftright("audio_id", 8 * k).bitwiseAND(F.lit(255)) for k in range(8)])).alias("place", "byte")
    least = asked.select("prints", "sound", "audio_id", byte).groupBy("prints", "sound", "place", "byte").agg(F.min("audio_id").alias("id"), F.count(F.lit(1)).alias("rows"))
    ids = F.slice(F.sort_array(F.collect_set("id")), 1, 2)
    return least.groupBy("prints", "sound").agg(ids.alias("ids"), F.sum(F.when(F.col("place") == 0, F.col("rows"))).alias("n"))


_ALIGNED = "audio_id long, prints binary, sound binary, n_matches long, best_match long, best_offset long, best_error double"


def align(prints: DataFrame, every: int = 20, block: int = BLOCK_QUERIES) -> DataFrame:
    """Each recording of :func:`fingerprints` with the queries it aligns with; queries have ids divisible by ``every``.

    Adds ``n_matches`` (query recordings, itself left out), and of the one with the fewest
    differing bits (then the least id) ``best_match``, ``best_offset`` (frames by which the
    recording starts within the query) and ``best_error``. Null, empty, short and silent
    recordings align with none. Recordings without id are no queries. Rows that repeat count.
    """
    spark = prints.sparkSession
    asked = prints.where(F.col("audio_id") % every == 0).where(F.length("prints") >= 4 * LEAST_OVERLAP)
    kinds = materialize(_kinds(asked), "audio-queries")
    size = kinds.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("prints") + F.length("sound")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    none = F.lit(None)
    out = prints.select("audio_id", "prints", "sound", F.lit(0).cast("long").alias("n_matches"), none.cast("long").alias("best_match"), none.cast("long").alias("best_offset"), none.cast("double").alias("best_error"))
    for k in range(blocks):
        part = kinds if blocks == 1 else kinds.where(F.pmod(F.xxhash64("prints", "sound"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast([(r["prints"], r["sound"], r["ids"], r["n"]) for r in part.orderBy(F.element_at("ids", 1)).toLocalIterator()])
        out = out.mapInArrow(_against(held, every), _ALIGNED)
        if blocks > 1:
            out = materialize(out, "audio-aligned")
    return out


#: The queries of the block that this worker compares now: built once, not in every task.
_BUILT: dict[str, Queries] = {}


def _queries(name: str, held) -> Queries:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Queries(held.value)
    return _BUILT[name]


def _against(held, every: int):
    name = uuid.uuid4().hex

    def run(batches):
        queries = _queries(name, held)
        for batch in batches:
            known: dict[tuple[bytes, bytes], list] = {}
            columns = [c.to_pylist() for c in batch.columns]
            for i, (own, prints, sound) in enumerate(zip(*columns[:3])):
                if (prints, sound) not in known:
                    known[prints, sound] = list(queries.aligned(np.frombuffer(prints, np.uint32), np.frombuffer(sound, bool)))
                for entry, offset, error in known[prints, sound]:
                    raw, heard, ids, n = queries.entries[entry]
                    itself = own is not None and own % every == 0 and raw == prints and heard == sound
                    others = [x for x in ids if not (itself and x == own)]
                    n -= itself
                    if n <= 0:
                        continue
                    columns[3][i] += n
                    match = others[0] if others else own
                    if columns[6][i] is None or (error, match) < (columns[6][i], columns[4][i]):
                        columns[4][i], columns[5][i], columns[6][i] = match, offset, error
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, batch.schema.types)], schema=batch.schema)

    return run


def digest(aligned: DataFrame) -> DataFrame:
    """One row for each recording: its fingerprint's length and checksum, and its alignment."""
    return aligned.select(F.col("audio_id").alias("vec_id"), (F.length("prints") / 4).cast("long").alias("n_prints"), F.crc32("prints").alias("prints_crc32"), "n_matches", "best_match", "best_offset", "best_error")


NOTE_SAMPLES = 496


def rendered(vectors: DataFrame, *, vector_id="vec_id", vector="embedding", lowest: float = -0.6, highest: float = 0.6) -> DataFrame:
    """``recording_id, audio``: a WAV melody of each vector, one note of three octaves for each number.

    The tables at hand hold no recordings; these stand in for them, one for each row.
    """
    prepare(vectors.sparkSession)

    def run(batches):
        for batch in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([melody(v, lowest, highest) for v in batch.column(1).to_pylist()], pa.binary())], ["recording_id", "audio"])

    return vectors.select(F.col(vector_id).cast("long").alias("recording_id"), _doubles(F.col(vector)).alias("vector")).mapInArrow(run, "recording_id long, audio binary")


def _doubles(column: Column) -> Column:
    return column.cast("array<double>")


def melody(values, lowest: float = -0.6, highest: float = 0.6, rate: int = RATE) -> bytes | None:
    if values is None:
        return None
    note = np.array([np.nan if v is None else v for v in values], float)
    step = np.clip(np.floor((np.nan_to_num(note) - lowest) / (highest - lowest) * 36), 0, 35)
    frequency = np.repeat(220 * 2 ** (step / 12), NOTE_SAMPLES * rate // RATE)
    sound = np.sin(2 * np.pi * np.cumsum(frequency) / rate) * 0.6
    return wav(sound, rate)


def wav(sound: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit mono WAV bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as sink:
        sink.setnchannels(1)
        sink.setsampwidth(2)
        sink.setframerate(rate)
        sink.writeframes((np.clip(sound, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()

