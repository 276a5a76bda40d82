"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts and items are read as words (A-Z lowered). A window is ten consecutive words
of an item; an item with fewer words, but at least one, is a single window. The
search runs over words instead of characters:

* windows of one length form a pattern set; a *shift table* keyed by blocks of words
  says how far the search may move on when a block is not the tail of any window, so
  most words are never compared;
* a block that ends some window (shift zero) opens a *suffix bucket* of windows, sorted by
  a hash of the words before their last block; direct comparison of all words confirms or
  rejects those that share it.

Words of the items are numbered, so that items, shift tables and buckets are arrays: about
thirty bytes for each window besides the distinct words themselves.

The windows are broadcast in blocks of bounded size: a benchmark above ``block_bytes``
is searched block by block, each block over all documents, with the hits carried along.
No shuffle is needed: every document is searched where it was read.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, parts, prepare, text_bytes, tidied

WINDOW = 10
#: UTF-8 bytes of item texts that one broadcast block may hold.
BLOCK_BYTES = 32 << 20

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of longer texts are numbered one by one, never listed.
_LISTED = 1 << 22
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words(text: bytes) -> list[bytes]:
    return _WORDS.findall(text.lower())  # bytes.lower() touches A-Z only


class WuManber:
    """Finds the windows of one length: ``starts`` are their places in ``flat``, the items' words as numbers."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, owners: np.ndarray, length: int):
        self.flat, self.length = flat, length
        self.block = block = min(length, 3 if length >= 6 else 2 if length >= 3 else 1)
        self.bits = max(10, int(4 * len(starts)).bit_length())
        self.shift = np.full(1 << self.bits, length - block + 1, np.uint8)
        slots = self._slots(flat)
        for move in range(length - block, -1, -1):  # the least one is written last
            self.shift[slots[starts + length - move - block]] = move
        key = self._bucketed(slots[starts + length - block], flat, starts)
        rank = np.argsort(key, kind="stable")
        self.key, self.starts, self.owners = key[rank], starts[rank], owners[rank]

    def _slots(self, numbers: np.ndarray) -> np.ndarray:
        """The slot of the block of words that begins at each place (of the last places: no block)."""
        n = max(0, len(numbers) - self.block + 1)
        value = np.zeros(n, np.uint64)
        for k in range(self.block):
            value += numbers[k : k + n].astype(np.uint64) * _ODD[k]
        return (mix64(value) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _bucketed(self, slots: np.ndarray, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What windows are sorted by: suffix bucket, then a hash of the words before the last block."""
        before = np.zeros(len(starts), np.uint64)
        for k in range(self.length - self.block):
            before = mix64(before * _ODD[0] + numbers[starts + k].astype(np.uint64) + np.uint64(1))
        return (slots.astype(np.uint64) << np.uint64(64 - self.bits)) | (before >> np.uint64(self.bits))

    def _candidates(self, slots: np.ndarray) -> np.ndarray:
        """Places whose block may end a window, reached by the shifts."""
        moves = self.shift[slots].tobytes()
        at, last, out = self.length - self.block, len(moves), []
        while at < last:
            move = moves[at]
            if move:
                at += move
            else:
                out.append(at)
                at += 1
        return np.array(out, np.int64)

    def search(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and owner of each occurrence in ``numbers`` (0: a word of no item)."""
        slots = self._slots(numbers)
        tails = self._candidates(slots)
        starts = tails - (self.length - self.block)
        key = self._bucketed(slots[tails], numbers, starts)
        low, high = np.searchsorted(self.key, key), np.searchsorted(self.key, key, side="right")
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        span, inside = np.arange(self.length), low < high
        for a, b, at in zip(low[inside].tolist(), high[inside].tolist(), starts[inside].tolist()):
            same = (self.flat[self.starts[a:b, None] + span] == numbers[at : at + self.length]).all(axis=1)
            owners = np.unique(self.owners[a:b][same])
            found.append((np.full(len(owners), at), owners))
        return tuple(np.concatenate(x) for x in zip(*found))


class Patterns:
    """All windows of the items, one searcher for each length."""

    def __init__(self, items, window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.names: list[str] = []
        flat, owner_of = array("i"), {}
        by_length: dict[int, tuple[list, list]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text or b"")]
            if ids:
                length = min(window, len(ids))
                owner = owner_of.setdefault(item, len(owner_of))
                starts, owners = by_length.setdefault(length, ([], []))
                starts.append(np.arange(len(flat), len(flat) + len(ids) - length + 1))
                owners.append(np.full(len(ids) - length + 1, owner, np.int32))
                flat.extend(ids)
        self.names = list(owner_of)
        held = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)
        self.searchers = [WuManber(held, np.concatenate(s), np.concatenate(o), n) for n, (s, o) in sorted(by_length.items(), reverse=True)]

    def numbered(self, text: bytes) -> np.ndarray:
        get = self.number.get
        if len(text) > _LISTED:
            return np.fromiter((get(m[0], 0) for m in _WORDS.finditer(text.lower())), np.int32)
        return np.array([get(w, 0) for w in words(text)], np.int32)

    def search(self, texts: list[bytes]):
        """Words of each text; then the text, first word, length and owner of each occurrence."""
        each = [self.numbered(t) for t in texts]
        n_words = np.array([len(x) for x in each], np.int64)
        first = np.cumsum(n_words + 1) - n_words - 1  # a number 0 ends each text, so no window reaches over it
        gap = np.zeros(1, np.int32)
        joined = np.concatenate([x for ids in each for x in (ids, gap)]) if each else gap
        found = [(np.zeros(0, np.int64),) * 4]
        for s in self.searchers:
            starts, owners = s.search(joined)
            text = np.searchsorted(first, starts, side="right") - 1
            found.append((text, starts - first[text], np.full(len(starts), s.length), owners))
        return n_words, *(np.concatenate(x) for x in zip(*found))


#: The patterns of the block that this worker searches now: built once, not in every task.
_BUILT: dict[str, Patterns] = {}


def _patterns(name: str, block) -> Patterns:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Patterns(block.value)
    return _BUILT[name]


def merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_SCHEMA = "hit_id long, hit_text string, n_words long, spans string, items string"


def _searched(docs: DataFrame, block) -> DataFrame:
    """docs: (hit_id, hit_text, n_words, spans, items); block: broadcast (id, bytes) pairs."""
    name = uuid.uuid4().hex

    def run(batches):
        patterns = _patterns(name, block)
        for batch in parts(batches, "hit_text"):
            n_words, *found = patterns.search(text_bytes(batch.column("hit_text")))
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            rank = np.argsort(found[0], kind="stable")
            text, start, length, owner = (x[rank] for x in found)
            hit, begin = np.unique(text, return_index=True)
            for i, a, b in zip(hit.tolist(), begin.tolist(), [*begin[1:].tolist(), len(text)]):
                ranges = set(zip(start[a:b].tolist(), (start[a:b] + length[a:b]).tolist()))
                ranges.update(map(tuple, json.loads(spans[i] or "[]")))
                names = {patterns.names[k] for k in np.unique(owner[a:b]).tolist()}.union(json.loads(items[i] or "[]"))
                spans[i] = json.dumps(merge(list(ranges)), separators=(",", ":"))
                items[i] = json.dumps(sorted(names))
            columns = [batch.column("hit_id"), batch.column("hit_text"), pa.array(n_words), pa.array(spans, pa.string()), pa.array(items, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["hit_id", "hit_text", "n_words", "spans", "items"])

    return docs.mapInArrow(tidied(run), _SCHEMA)


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int):
    """The items as broadcasts of (id, bytes) pairs, each of about ``block_bytes``; rows of one id are in one block."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t") + 16).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        yield blocks, benchmark.sparkSession.sparkContext.broadcast([(r["i"], r["t"].encode()) for r in part.toLocalIterator()])


def search(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", item_id="item_id", item_text="text", block_bytes=BLOCK_BYTES) -> DataFrame:
    """Where windows of benchmark items occur in each document.

    Returns ``doc_id, text, n_words, spans, item_ids``: ``spans`` are the merged word ranges
    ``[start, end)`` that occurrences cover, ``item_ids`` the items (as text) with an occurring
    window, sorted. Null or wordless documents have no words and no hits; null or wordless items
    no windows; items without id count as an item with an empty id. Rows that repeat stay; rows
    of the benchmark that share an id are one item. A null document id stays null; very long texts
    are searched whole; other columns are ignored. An empty benchmark hits nothing.
    """
    prepare(docs.sparkSession)
    none = F.lit(None)
    out = docs.select(F.col(doc_id).cast("long").alias("hit_id"), F.col(text).alias("hit_text"), none.cast("long").alias("n_words"), none.cast("string").alias("spans"), none.cast("string").alias("items"))
    for blocks, held in item_blocks(benchmark, item_id, item_text, block_bytes):
        out = _searched(out, held)
        if blocks > 1:
            out = materialize(out, "decontaminate")
    return out.select(F.col("hit_id").alias("doc_id"), F.col("hit_text").alias("text"), "n_words", F.from_json(F.coalesce("spans", F.lit("[]")), "array<array<long>>").alias("spans"), F.from_json(F.coalesce("items", F.lit("[]")), "array<string>").alias("item_ids"))


def digest(found: DataFrame) -> DataFrame:
    """One row per document from :func:`search`: counts, the items' digest and the verdict."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def kept(docs: DataFrame, benchmark: DataFrame, *, text="text", item_id="item_id", item_text="text", block_bytes=BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows in whose text a window of a benchmark item occurs; all columns stay as they are."""
    prepare(docs.sparkSession)
    place = docs.columns.index(text)

    def without(held):
        name = uuid.uuid4().hex

        def run(batches):
            patterns = _patterns(name, held)
            for batch in parts(batches, place):
                clean = np.ones(batch.num_rows, bool)
                clean[patterns.search(text_bytes(batch.column(place)))[1]] = False
                yield batch.filter(pa.array(clean))

        return run

    out = docs
    for blocks, held in item_blocks(benchmark, item_id, item_text, block_bytes):
        out = out.mapInArrow(tidied(without(held)), docs.schema)
        if blocks > 1:
            out = materialize(out, "decontaminate")
    return out
