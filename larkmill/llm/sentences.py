"""Removal of repeated passages by sliding sentence spans.

Texts are parted into sentences: after ``.``, ``!`` or ``?`` and white space, and at line
ends. Long sentences are parted further where their own words say so: at a word whose hash is
the least among its ``RADIUS`` neighbours on either side, if no sentence begins within
``APART`` words. So two copies of a passage are parted alike a few words after they begin,
wherever they begin. A stretch of over ``LONGEST`` words without such a place (a word over
and over) is parted by counting.

Every run of several consecutive sentences is hashed: from each sentence the shortest run of
at least ``SENTENCES`` sentences and ``WORDS`` words forwards, and likewise backwards, so that
a repeated passage is covered up to both its ends but for parts of sentences there. Hashes
are joined globally: 64 bits to meet by and 31 bits of another kind to confirm. The first
occurrence (least document id, then text, then place) stays, and the sentences that any other
occurrence covers are removed.

A document is an id with a text: texts that share an id are cut each by its own spans, and of
rows that repeat one is the first occurrence. Each task joins the spans of a block of its
texts first: all but the least of equal spans go for certain, and only the least is shuffled.
So a passage that is in every document is one row for each block, and no hash is hot. What is
to go reaches the texts by id and text hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, WORD, materialize, parts, prepare, prime_hashes, release, run_hashes, text_buffer, tidy, word_hashes, word_runs

SENTENCES = 3
WORDS = 20
RADIUS, APART = 3, 4
LONGEST = 24
#: Bytes of text that are looked at together, and whose spans are joined in one task.
SLICE = 1 << 20
BLOCK = 16 << 20

_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _parted(data: np.ndarray, offsets: np.ndarray):
    """(A-Z lowered bytes, start and end of every word, words before each text, each word's text, whether it begins a sentence)."""
    n = len(data)
    low = LOWER[data]
    starts, ends, before = word_runs(low, WORD, offsets)
    brk = np.zeros(n + 1, np.int64)
    brk[1:n] = (_STOP[data[:-1]] & _SPACE[data[1:]]) | (data[:-1] == 10)
    crossed = np.cumsum(brk[:n])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (crossed[starts[1:]] != crossed[starts[:-1]]) | (owner[1:] != owner[:-1])
    return low, starts, ends, before, owner, fresh


def sentences(data: np.ndarray, offsets: np.ndarray):
    """(start, end, words, hash, second hash) of every sentence, bytes from the buffer's start, and sentences before each text.

    A sentence ends where the next begins, so they cover a text. The hashes are of the words, A-Z lowered.
    """
    low, starts, ends, _, owner, fresh = _parted(data, offsets)
    if not len(starts):
        zero = np.zeros(0, np.int64)
        return zero, zero, zero, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    words = word_hashes(low, starts, ends)
    first = np.flatnonzero(fresh | _anchors(words, fresh))
    size = np.diff(np.append(first, len(words)))
    pieces = -(-size // LONGEST)
    first = np.repeat(first, pieces) + LONGEST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    last = np.append(first[1:], len(words))
    text = owner[first]
    a = starts[first]
    at = np.searchsorted(text, np.arange(len(offsets)))
    heads = at[:-1][np.diff(at) > 0]
    a[heads] = offsets[text[heads]]  # what comes before the first word belongs to it
    b = np.append(a[1:], len(low))
    tails = at[1:][np.diff(at) > 0] - 1
    b[tails] = offsets[text[tails] + 1]
    return a, b, last - first, _chained(words, first, last), prime_hashes(words, first, last), at


def _least(value: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        value = np.minimum(value[:-step], value[step:])
        done += step
    return value


def _anchors(words: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The words within sentences at which they are parted; of equal neighbours none is."""
    n, edge = len(words), np.full(RADIUS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    around = np.concatenate([edge, words, edge])
    before, after = _least(around, RADIUS)[:n], _least(around, RADIUS)[RADIUS + 1 :]
    begun = np.append(np.flatnonzero(fresh), n)
    k = np.cumsum(fresh)  # sentences begun up to each word
    place = np.arange(n)
    return (words < before) & (words < after) & (place - begun[k - 1] >= APART) & (begun[k] - place >= APART)


def _chained(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each range of hashes, order included."""
    raw = words.view(np.uint8)
    return run_hashes(raw, first * 8, last * 8)


def spans(words: np.ndarray, value: np.ndarray, more: np.ndarray, at: np.ndarray, least: int = SENTENCES, least_words: int = WORDS):
    """(text, first sentence, end sentence, hash, second hash) of the runs to compare; sentences are numbered within their text."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    i = np.arange(n)
    forward = np.maximum(i + least, np.searchsorted(total, total[:-1] + least_words))
    backward = np.minimum(i + 1 - least, np.searchsorted(total, total[1:] - least_words, side="right") - 1)
    ok, ko = forward <= at[1:][text], backward >= at[:-1][text]
    a, b = np.concatenate([i[ok], backward[ko]]), np.concatenate([forward[ok], i[ko] + 1])
    key = np.unique(a * (n + 1) + b)
    a, b = key // (n + 1), key % (n + 1)
    return text[a], a - at[text[a]], b - at[text[a]], _chained(value, a, b), prime_hashes(more, a, b).astype(np.int32)


#: A document: whether it has no id, its id (0 without) and the hash of its text.
_KEY = ["no_id", "id", "text_hash"]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``no_id, id, text_hash, text`` of every row."""
    key = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text"))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.select(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), key.alias("text_hash"), "text")


_SPANS = "no_id boolean, id long, text_hash long, first int, last int, h long, g int, least boolean"


def span_rows(docs: DataFrame, *, doc_id="doc_id", text="text", least=SENTENCES, least_words=WORDS, block=BLOCK) -> DataFrame:
    """Every run to compare, with its two hashes; documents without words have none.

    ``least`` is true for the first of the equal runs of a block of texts; the others are
    repetitions, whatever the other blocks hold.
    """
    prepare(docs.sparkSession)

    def joined(keys, runs):
        """The runs of one block, in the order of their hashes and places."""
        no_id, ids, hashes = (np.concatenate(x) for x in zip(*keys))
        first, last, h, g, owner = (np.concatenate(x) for x in zip(*runs))
        order = np.lexsort((hashes, ids, no_id))
        rank = np.empty(len(ids), np.int64)  # rows that repeat share one
        rank[order] = np.cumsum(_changes(no_id[order], ids[order], hashes[order]))
        order = np.lexsort((first, rank[owner], g, h))
        order = order[_changes(h[order], g[order], rank[owner][order], first[order])]
        first, last, h, g, owner = (x[order] for x in (first, last, h, g, owner))
        fresh = _changes(h, g)
        for k in range(0, len(h), 1 << 16):
            part = slice(k, k + (1 << 16))
            who = owner[part]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (no_id[who], ids[who], hashes[who], first[part].astype(np.int32), last[part].astype(np.int32), h[part].view(np.int64), g[part], fresh[part])], _SPAN_NAMES)

    def run(batches):
        keys, runs, held, rows = [], [], 0, 0
        for batch in parts(batches, "text", SLICE):
            data, offsets = text_buffer(batch.column("text"))
            _, _, sizes, value, more, at = sentences(data, offsets)
            owner, *run_of = spans(sizes, value, more, at, least, least_words)
            keys.append((np.asarray(batch.column("no_id").cast(pa.int8())).astype(bool), np.asarray(batch.column("id")), np.asarray(batch.column("text_hash"))))
            runs.append((*run_of, owner + rows))
            held, rows = held + len(data), rows + batch.num_rows
            if held >= block:
                yield from joined(keys, runs)
                keys, runs, held, rows = [], [], 0, 0
        if keys:
            yield from joined(keys, runs)

    return _keyed(docs, doc_id, text).mapInArrow(run, _SPANS)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


_SPAN_NAMES = [*_KEY, "first", "last", "h", "g", "least"]


def repeated(rows: DataFrame) -> DataFrame:
    """``no_id, id, text_hash, first, last`` of every span that is not the first with its hashes."""
    among = Window.partitionBy("h", "g").orderBy(*_KEY, "first")  # one row of each block at most
    later = rows.where("least").select(*_KEY, "first", "last", F.rank().over(among).alias("n")).where("n > 1").drop("n")
    return later.unionByName(rows.where("not least").select(*_KEY, "first", "last"))


def removed_ranges(again: DataFrame) -> DataFrame:
    """``no_id, id, text_hash, cuts``: for each document the ranges of sentences that go, merged before they are gathered."""
    # the farthest end for each start: no document has more ranges than sentences
    far = again.groupBy(*_KEY, "first").agg(F.max("last").alias("last"))
    return far.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cuts"))


_CUT = "doc_id long, text string, n_sentences long, n_removed long"


def dedup(docs: DataFrame, *, doc_id="doc_id", text="text", least=SENTENCES, least_words=WORDS, block=BLOCK) -> DataFrame:
    """``doc_id, text, n_sentences, n_removed``: every document without its repeated passages.

    A repetition within one document counts too. Occurrences are in the order of the documents'
    ids, those without an id last; of different texts that share an id, each is a document of
    its own, ordered by a hash of the text. Rows that repeat (same id and text) stay as rows,
    and all but one lose every passage that can be compared. Null texts stay null, empty ones
    empty; a text all of whose sentences go becomes empty. Very long texts are compared and
    cut whole. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = materialize(span_rows(docs, doc_id=doc_id, text=text, least=least, least_words=least_words, block=block), "spans")
    cuts = materialize(removed_ranges(repeated(rows)), "span-cuts")
    release(rows)
    tidy(spark)
    # rows that repeat are one here, however many they are
    whole = _keyed(docs, doc_id, text).groupBy(*_KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    joined = whole.join(cuts, _KEY, "left").select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "text", "copies", F.col("cuts.first").alias("first"), F.col("cuts.last").alias("last"))

    def run(batches):
        for batch in parts(batches, "text", SLICE):
            data, offsets = text_buffer(batch.column("text"))
            a, _, sizes, value, more, at = sentences(data, offsets)
            texts, ids, copies, firsts, lasts = (batch.column(c).to_pylist() for c in ("text", "doc_id", "copies", "first", "last"))
            if any(n > 1 for n in copies):
                owner, starts, ends, _, _ = spans(sizes, value, more, at, least, least_words)

            def without(k, first, last):
                """The text without the ranges, and how many sentences they touch."""
                x, y = offsets[k], offsets[k + 1]
                units = np.append(a[at[k] : at[k + 1]], y) - x
                out = np.zeros(len(units), np.int64)
                np.add.at(out, first, 1)
                np.add.at(out, last, -1)
                out = np.cumsum(out)[:-1] > 0
                return data[x:y][~np.repeat(out, np.diff(units))].tobytes().decode("utf-8", "replace"), int(out.sum())

            rows = []
            for k, text in enumerate(texts):
                n = int(at[k + 1] - at[k])
                rows.append((ids[k], *(without(k, firsts[k], lasts[k]) if firsts[k] else (text, 0)), n))
                if copies[k] > 1:
                    mine = np.flatnonzero(owner == k)
                    again = (ids[k], *(without(k, starts[mine], ends[mine]) if len(mine) else (text, 0)), n)
                    for done in range(1, copies[k], 1000):
                        rows += [again] * min(1000, copies[k] - done)
                        yield _cut_rows(rows)
                        rows = []
            yield _cut_rows(rows)

    return joined.mapInArrow(run, _CUT)


def _cut_rows(rows) -> pa.RecordBatch:
    ids, texts, gone, count = zip(*rows) if rows else ([],) * 4
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(count, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_sentences", "n_removed"])
