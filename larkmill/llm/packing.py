"""Packing documents into token sequences by linear grouping, configurations and best fit.

Documents are tokenized where they are read; a document's ids end with an end id, and only
documents longer than a sequence are cut (the first piece takes the remainder). What the
driver plans with is the histogram of piece lengths, at most ``capacity`` numbers however
many documents there are:

1. large lengths, longest first, are dealt into groups of equal cardinality and rounded up
   to the longest of their group, which leaves few sizes;
2. the configuration linear programme over these sizes is solved by column generation
   (a knapsack prices new configurations), and its solution rounded down;
3. actual lengths replace the rounded ones, which leaves room in most sequences;
4. everything else, longest first, goes where it fits best, else into a new sequence.

Sequences are planned in runs of equal content, so a plan has a few ten thousand rows at
most, each ``documents of length l with ranks a.. go to sequences b.. at offset o``. Pieces
get their rank within their length by a salted row number (no length is one task's work),
and look their place up in the broadcast plan.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parts, prepare, release, slices, text_buffer, tidied, tidy

CAPACITY = 2048
END_ID = 0
#: Lengths above this share of a sequence are large.
LARGE_SHARE = 1 / 8
#: Numbers of groups that are tried; the plan with the fewest sequences stays.
GROUPS = (24, 48, 96)
#: Bytes of remembered pieces and their ids in a worker; pieces of over LONG_PIECE bytes are not remembered.
REMEMBERED_BYTES = 24 << 20
LONG_PIECE = 64
#: New pieces that are encoded end to end, and how many such runs at a time.
JOINED = 500
RUNS = 16
#: Bytes of text that are encoded together.
SLICE = 2 << 20
#: Pieces that one task ranks within one length, about.
RANKED_TOGETHER = 100_000

_ODD_SPACE = re.compile(r"[^\S \n]")
#: Lead bytes of all white space but blanks and line feeds, and of much else.
_DOUBTFUL = np.zeros(256, bool)
_DOUBTFUL[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _boundaries() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and for two classes (8 * first + second) whether the byte-level pattern always ends a match between them."""
    punctuation, letter, digit, blank, apostrophe, bar, beyond = range(7)
    kind = np.full(256, punctuation, np.uint8)
    for byte in range(128):
        if chr(byte).isalpha():
            kind[byte] = letter
        elif chr(byte).isdigit():
            kind[byte] = digit
    kind[[32, 10]], kind[39], kind[124], kind[128:] = blank, apostrophe, bar, beyond
    ends = np.zeros((8, 8), bool)
    ends[[punctuation, letter, digit, apostrophe, bar, beyond], blank] = True
    ends[letter, [punctuation, digit, apostrophe]] = True
    ends[digit, [punctuation, letter, apostrophe, bar]] = True
    ends[punctuation, [letter, digit]] = True
    ends[[apostrophe, bar], digit] = True  # an apostrophe may begin 's; a bar stands beside the letters of <|special|>
    return kind, ends.ravel()


_KIND, _ENDS = _boundaries()


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces that can be encoded by themselves begin in texts laid end to end; at each text's start too."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    begins = np.zeros(len(data), bool)
    np.take(_ENDS, (kind[:-1] << 3) | kind[1:], out=begins[1:])
    begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    The byte-level pattern never joins a non-space to a following blank, nor an ASCII letter, digit
    or sign to one of the others, but for what an apostrophe begins. So a text's pieces between such
    places are encoded one by one, each distinct one once, and remembered. Texts with white space other than
    blanks and line feeds are encoded whole, as all are by a tokenizer of another pattern.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # remembered pieces, their ids end to end, where each one's begin, and how many it has
        self.known = pa.array([], pa.large_string())
        self.ids, self.first, self.count = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.parted = self._parted()

    def _parted(self) -> bool:
        """Whether this tokenizer never joins what :func:`piece_starts` parts."""
        before = self.tokenizer.pre_tokenizer
        state = json.loads(before.__getstate__()) if before is not None else {}
        if self.tokenizer.normalizer is not None or state.get("type") != "ByteLevel" or state.get("add_prefix_space") or not state.get("use_regex"):
            return False
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        return all(len(piece_starts(np.frombuffer(t, np.uint8), np.array([0, len(t)]))) == 1 for t in added)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Encode pieces end to end, in runs: each starts with a blank after a non-blank, so none changes its neighbours' ids."""
        joined, alone = [], []
        for p in pieces:
            (joined if self.parted and p[0] in " \n" and not p[-1].isspace() and "<|" not in p else alone).append(p)
        if len(self.sizes) == 0:
            vocabulary = self.tokenizer.get_vocab()
            self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, k in vocabulary.items():
                self.sizes[k] = len(token)  # a character stands for a byte
        learned: dict[str, bytes] = {}
        runs = [joined[a : a + JOINED] for a in range(0, len(joined), JOINED)]
        for first in range(0, len(runs), RUNS):
            some = runs[first : first + RUNS]
            for run, encoding in zip(some, self.tokenizer.encode_batch_fast(["".join(r) for r in some], add_special_tokens=False)):
                ids = np.array(encoding.ids, "<u4")
                ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum([len(p.encode()) for p in run])
                at = np.searchsorted(ends, wanted)
                if at[-1] >= len(ids) or not np.array_equal(ends[at], wanted):
                    alone += run
                    continue
                raw, at = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
                learned.update(zip(run, (raw[a:b] for a, b in zip(at, at[1:]))))
        for a in range(0, len(alone), JOINED):
            learned.update(zip(alone[a : a + JOINED], self._encode(alone[a : a + JOINED])))
        return [learned[p] for p in pieces]

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct pieces: ids end to end (with others between), where each one's begin, how many it has."""
        at = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = at < 0
        if not missing.any():
            return self.ids, self.first[at], self.count[at]
        new = pieces.filter(pa.array(missing))
        raws = self._learn(new.to_pylist())
        more = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(raws), "<u4")])
        first = np.concatenate([self.first, len(self.ids) + np.cumsum(more) - more])
        count = np.concatenate([self.count, more])
        at[missing] = len(self.known) + np.arange(len(new))
        self._remember(pa.concat_arrays([self.known, new]), ids, first, count, at)
        return ids, first[at], count[at]

    def _remember(self, known: pa.Array, ids: np.ndarray, first: np.ndarray, count: np.ndarray, at: np.ndarray) -> None:
        """Keep all pieces but long ones; when that is too much, those ``at`` hand, and of them as many as half the bytes hold."""
        size = pc.binary_length(known).to_numpy()
        keep = size <= LONG_PIECE
        cost = size + 4 * count + 24
        if cost[keep].sum() > REMEMBERED_BYTES:
            now = np.zeros(len(known), bool)
            now[at] = True
            keep &= now
            keep &= np.cumsum(cost * keep) <= REMEMBERED_BYTES // 2
        if not keep.all():
            known, first, count = known.filter(pa.array(keep)), first[keep], count[keep]
            ids, first = _gathered(ids, first, count), np.cumsum(count) - count
        self.known, self.ids, self.first, self.count = known, ids, first, count

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        data, offsets = text_buffer(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        return [raw for a, b in slices(offsets, SLICE) for raw in self._slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        if len(data) == 0:
            return [b""] * (len(offsets) - 1)
        starts = piece_starts(data, offsets)
        if self.parted:
            texts = np.unique(np.searchsorted(offsets, np.flatnonzero(_DOUBTFUL[data]), side="right") - 1).tolist()
            whole = [k for k in texts if _ODD_SPACE.search(data[offsets[k] : offsets[k + 1]].tobytes().decode())]
        else:
            whole = range(len(offsets) - 1)
        if len(whole):
            odd = np.zeros(len(offsets) - 1, bool)
            odd[whole] = True
            owner = np.searchsorted(offsets, starts, side="right") - 1
            starts = starts[~odd[owner] | (starts == offsets[owner])]
        ends = pa.py_buffer(np.append(starts, len(data)))
        pieces = pa.LargeStringArray.from_buffers(len(starts), ends, pa.py_buffer(data)).dictionary_encode()
        ids, first, count = self._ids(pieces.dictionary)
        index = pieces.indices.to_numpy()
        first, count = first[index], count[index]
        ids = _gathered(ids, first, count)
        upto = np.concatenate([[0], np.cumsum(count)])
        cut = upto[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:])]


def _gathered(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Runs of values, given by their places and sizes, end to end."""
    place = np.repeat(first - (np.cumsum(count) - count), count)
    place += np.arange(len(place))
    return values[place]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with ``n`` ids."""
    head = n % capacity or capacity
    return [(0, head)] + [(a, capacity) for a in range(head, n, capacity)]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def tokenize(docs: DataFrame, *, tokenizer: str | None = None, capacity=CAPACITY, end_id=END_ID, with_ids=True, doc_id="doc_id", text="text") -> DataFrame:
    """One row for each piece of each document; ``ids`` as little-endian 32-bit bytes (null without ``with_ids``)."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer or default_tokenizer())
        for batch in parts(batches, "packed_text", SLICE):
            ids = encode(batch.column("packed_text"))
            owner, piece, start, length, crc, kept = [], [], [], [], [], []
            for d, raw in zip(batch.column("packed_id").to_pylist(), ids):
                raw += end
                for k, (a, n) in enumerate(cut(len(raw) // 4, capacity)):
                    part = raw[4 * a : 4 * (a + n)]
                    owner.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    kept.append(part if with_ids else None)
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("packed_id"), F.col(text).alias("packed_text")).mapInArrow(tidied(run), _PIECES)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """A basis of the configuration programme: (copies of each size, times used).

    It is optimal unless ``60 * m`` steps don't suffice for ``m`` sizes; then the last basis is
    given, which packs everything too, in a few sequences more.
    """
    m = len(sizes)
    size, need = np.array(sizes), np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    used = inverse @ need
    for _ in range(60 * m):
        price = inverse.sum(axis=0)
        column = _knapsack(size, price, capacity)
        if price @ column <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-10, used / np.maximum(step, 1e-10), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        used = used - ratio[out] * step
        used[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    return [(basis[:, j].astype(int).tolist(), float(used[j])) for j in range(m)]


def _knapsack(size: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of the largest total price."""
    best = np.zeros(capacity + 1)
    layers = []
    for s, p in zip(size.tolist(), price.tolist()):
        if p <= 0:
            layers.append(None)
            continue
        layer = best
        for _ in range(capacity // s):
            more = layer.copy()
            np.maximum(more[s:], layer[:-s] + p, out=more[s:])
            if np.array_equal(more, layer):
                break
            layer = more
        layers.append(best)
        best = layer
    left, column = capacity, np.zeros(len(size))
    value = best
    for k in range(len(size) - 1, -1, -1):
        if layers[k] is None:
            continue
        s, p, before = int(size[k]), price[k], layers[k]
        # so many copies of size k that the rest is optimal without it
        n, at = 0, value[left]
        while before[left] < at - 1e-12 and left >= s:
            n, left, at = n + 1, left - s, at - p
        column[k], value = n, before
    return column


class _Plan:
    """Runs of sequences with equal content."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list] = [[] for _ in range(capacity + 1)]
        self.rooms = np.zeros(capacity + 1, bool)
        self.sequences = 0

    def add(self, count: int, room: int, content: list) -> None:
        self.by_room[room].append((count, room, content))
        self.rooms[room] = True

    def best(self, size: int) -> int | None:
        k = int(np.argmax(self.rooms[size:]))
        return size + k if self.rooms[size + k] else None

    def take(self, room: int):
        run = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms[room] = False
        return run


def _moved(content: list, by: int) -> list:
    return [(length, start + by, offset) for length, start, offset in content]


def plan(histogram: dict[int, int], groups: int, capacity: int = CAPACITY, large_share: float = LARGE_SHARE):
    """Places for all pieces: (number of sequences, rows of (length, first rank, count, first sequence, offset))."""
    left = {n: c for n, c in histogram.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    out = _Plan(capacity)
    if full := left.pop(capacity, 0):
        out.add(full, 0, [(capacity, 0, 0)])
        rank[capacity] = full
    large = sorted((n for n in left if n > capacity * large_share), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        per_group = -(-total // groups)
        dealt: list[list[list[int]]] = []  # of each group: [length, count], longest first
        room = 0
        for n in large:
            c = left[n]
            while c:
                if not room:
                    dealt.append([])
                    room = per_group
                k = min(c, room)
                dealt[-1].append([n, k])
                c, room = c - k, room - k
        merged: dict[int, list[list[int]]] = {}
        for g in dealt:
            queue = merged.setdefault(g[0][0], [])
            for n, k in g:
                if queue and queue[-1][0] == n:  # groups of one rounded size continue each other
                    queue[-1][1] += k
                else:
                    queue.append([n, k])
        sizes = list(merged)
        demand = [sum(k for _, k in merged[s]) for s in sizes]
        for copies, times in configurations(sizes, demand, capacity):
            times = int(times + 1e-6)
            slots = [s for s, n in zip(sizes, copies) for _ in range(n)]
            while times > 0 and slots:
                sources = []
                held = {s: [list(x) for x in merged[s]] for s in set(slots)}
                count = times
                for s in slots:  # the run goes on as long as every slot keeps its length
                    queue = held[s]
                    while queue and not queue[0][1]:
                        queue.pop(0)
                    if not queue:
                        count = 0
                        break
                    take = min(queue[0][1], count)
                    sources.append((s, queue[0][0]))
                    count = take
                    queue[0][1] -= take
                if not count:
                    break
                content, offset = [], 0
                for s, n in sources:
                    queue, want = merged[s], count
                    first = next(x for x in queue if x[0] == n and x[1])
                    assert first[1] >= want
                    first[1] -= want
                    content.append((n, rank[n], offset))
                    rank[n] += want
                    left[n] -= want
                    offset += n
                out.add(count, capacity - offset, content)
                times -= count
    for n in sorted(left, reverse=True):
        while c := left[n]:
            room = out.best(n)
            count, room, content = (1 << 62, capacity, []) if room is None else out.take(room)
            copies = min(room // n, c)
            bins = min(count, c // copies)
            offset, added = capacity - room, []
            for k in range(copies):
                added.append((n, rank[n] + k * bins, offset + k * n))
            rank[n] += copies * bins
            left[n] = c - copies * bins
            out.add(bins, room - copies * n, content + added)
            if content and count > bins:
                out.add(count - bins, room, _moved(content, bins))
    rows, sequences = [], 0
    for runs in out.by_room:
        for count, _, content in runs:
            rows += [(n, start, count, sequences, offset) for n, start, offset in content]
            sequences += count
    return sequences, rows


def best_plan(histogram: dict[int, int], groups=GROUPS, capacity: int = CAPACITY):
    return min((plan(histogram, g, capacity) for g in groups), key=lambda p: p[0])


_PLACED = _PIECES + ", sequence_id long, offset long"


def pack(docs: DataFrame, *, capacity=CAPACITY, groups=GROUPS, with_ids=True, **options) -> DataFrame:
    """Every piece with its sequence: ``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``.

    A null or empty text is the end id alone. Rows that repeat are packed as often as they
    occur; pieces that can't be told apart may change places. Without documents there are no
    rows. ``with_ids=False`` leaves the ids null, as when only the layout is wanted.
    """
    pieces = materialize(tokenize(docs, capacity=capacity, with_ids=with_ids, **options), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    return place(pieces, counts, groups, capacity)


def place(pieces: DataFrame, counts: dict[int, int], groups=GROUPS, capacity: int = CAPACITY) -> DataFrame:
    spark = pieces.sparkSession
    _, rows = best_plan(counts, groups, capacity)
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(table)
    salts = max(64, -(-max(counts.values(), default=0) // RANKED_TOGETHER))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("rank") + F.col("base")).cast("long").alias("rank"))

    def run(batches):
        keys = (held.value[:, 0] << 44) + held.value[:, 1]
        for batch in batches:
            n, r = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            k = np.searchsorted(keys, (n << 44) + r, side="right") - 1
            row = held.value[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(row[:, 3] + r - row[:, 1]), pa.array(row[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    return ranked.mapInArrow(tidied(run), _PLACED)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id, n_ids, ids`` (little-endian 32-bit bytes), from :func:`pack` with ids."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence holds at most its capacity
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), held.alias("parts")).select("sequence_id", "n_ids", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def digest(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
