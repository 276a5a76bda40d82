"""URL verdicts from host and path rules, then from character language models.

A rule (host, path) fits its host and all subdomains where the url's path starts with the
rule's; the longest fitting rule decides. For urls without a rule, two smoothed
variable-order Markov models are compared, one of the urls that rules accept and one of
those that they reject: the difference of their log-likelihoods per character, against a
calibrated threshold.

The models are learned from every url that has a rule's verdict. A gram is a context of 0
to ``ORDER`` symbols and the symbol after it; as a symbol has six bits, a gram is one exact
number and no two share a count. Spark sums the grams of all urls, and every gram counts.

Workers hold the grams that occur at least as often as makes them ``GRAMS`` at most (once is
enough for smaller tables). What a symbol adds to a score depends on its window alone, the
gram of the longest context: windows that are held are scored at once, as all their shorter
grams are held too, and totals of contexts are those of all grams. The other windows are asked
of the whole table: their distinct ones and the grams of longer contexts meet in shards by the
last symbols before (:func:`_rest_values`), and values are joined back to the urls. So every
score is that of the whole model, and the state of the driver and of each worker has a fixed
bound.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import LOWER, again, discard, materialize, pack, prepare, release, slices, text_buffer, unpack, written

#: The rules, longest match wins.
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

ORDER = 5
#: Grams that a worker may hold, 24 bytes each; the rest are asked of their table.
GRAMS = 1 << 21
#: Orders below this one have at most 64 + 64**2 + 64**3 grams, which are always held.
LOW_ORDERS = 3
#: Grams or asked windows of a shard, about; those that share three symbols are together, 64**3 at most of an order.
SHARD = 1 << 19
#: Bytes of urls whose windows are listed together.
PART_BYTES = 2 << 20
#: One in so many ruled urls calibrates the threshold and is not counted.
CALIBRATE = 8
SLICE = 1 << 20
_LETTERS = 64
_SYMBOL_BITS = 6


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``ruling`` (allow or block; both null without a rule) from ``host`` and ``path``."""
    fitting = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        fitting.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("ruling"))))
    found = F.coalesce(*fitting) if fitting else F.lit(None).cast("struct<rule:string,ruling:string>")
    return pages.withColumn("found", found).withColumn("rule", F.col("found.rule")).withColumn("ruling", F.col("found.ruling")).drop("found")


def symbols(data: np.ndarray, offsets: np.ndarray):
    """Bytes as 0..63 (A-Z lowered, rare ones share a symbol), each url ended by symbol 0; and the new offsets."""
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1)
    out = np.zeros(int(at[-1]), np.uint8)
    ends = np.zeros(len(out), bool)
    ends[at[1:] - 1] = True
    out[~ends] = _SYMBOL[LOWER[data]]
    return out, at


_SYMBOL = (np.arange(256) % 7 + 57).astype(np.uint8)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%"):
    _SYMBOL[ord(_c)] = min(_k + 1, 56)


def grams(out: np.ndarray, at: np.ndarray, order: int = ORDER):
    """For each order: every symbol behind its context as one number (before a url's start there are symbols 0)."""
    n = len(out)
    since = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    context = np.zeros(n, np.int64)
    for k in range(order + 1):
        if 0 < k < n:
            before = np.where(since[k:] >= k, out[:-k], 0).astype(np.int64)
            context[k:] |= before << (_SYMBOL_BITS * (k - 1))
        yield (((np.int64(k) << (_SYMBOL_BITS * order)) | context) << _SYMBOL_BITS) | out


@dataclass
class Markov:
    """Counts of grams (sorted numbers of :func:`grams`) in both classes.

    ``contexts``: numbers, totals and kinds of the grams' contexts, where these have grams that
    are not among ``keys``; ``rest``: where those are.
    """

    keys: np.ndarray
    counts: np.ndarray  # gram, class
    order: int = ORDER
    cut: float = 0.0
    contexts: tuple | None = None
    rest: "Rest | None" = None

    def __post_init__(self):
        # a last gram that no url has: look-ups end there at the latest
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.counts = np.vstack([self.counts, np.zeros((1, 2))])
        if self.contexts is None:
            before = self.keys >> _SYMBOL_BITS
            first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
            self.contexts = before[first], np.add.reduceat(self.counts, first, axis=0), np.add.reduceat(self.counts > 0, first, axis=0, dtype=np.float64)
        else:
            number, totals, kinds = self.contexts
            self.contexts = np.append(number, np.iinfo(np.int64).max), np.vstack([totals, np.zeros((1, 2))]), np.vstack([kinds, np.zeros((1, 2))])

    def blended(self, window: np.ndarray, p: np.ndarray, orders) -> np.ndarray:
        """Probabilities of windows' symbols in both classes after these orders, from ``p`` before them (Witten-Bell blend)."""
        contexts, totals, all_kinds = self.contexts
        for k in orders:
            gram = shortened(window, k, self.order)
            found = np.searchsorted(self.keys, gram)
            count = np.where((self.keys[found] == gram)[:, None], self.counts[found], 0)
            before = gram >> _SYMBOL_BITS
            found = np.searchsorted(contexts, before)
            seen = (contexts[found] == before)[:, None]
            total, kinds = np.where(seen, totals[found], 0), np.where(seen, all_kinds[found], 0)
            whole = np.maximum(total + kinds, 1)  # 0 where the context is unknown: the shorter one decides
            p = count / whole + np.where(total > 0, kinds / whole, 1) * p
        return p

    def held(self, window: np.ndarray) -> np.ndarray:
        """Whether a window's value can be told from the grams held."""
        return self.keys[np.searchsorted(self.keys, window)] == window

    def values(self, window: np.ndarray) -> np.ndarray:
        """Log-likelihood difference, accepted minus rejected, of windows' symbols."""
        return _difference(self.blended(window, _even(len(window)), range(self.order + 1)))

    def per_symbol(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean difference per symbol of each url, if all grams are held."""
        if self.rest is not None:
            raise ValueError("grams are not all held: use scored")
        window, place, at = windows(data, offsets, self.order)
        return _means(self.values(window)[place], at)


@dataclass
class Rest:
    """All grams of a model in their table; ``low``: those of the orders below LOW_ORDERS."""

    table: DataFrame
    size: int
    low: Markov


def shortened(window: np.ndarray, k: int, order: int) -> np.ndarray:
    """The gram of order ``k`` in a window, the gram of the longest context."""
    symbol, context = window & ((1 << _SYMBOL_BITS) - 1), (window >> _SYMBOL_BITS) & ((1 << (_SYMBOL_BITS * k)) - 1)
    return (((np.int64(k) << (_SYMBOL_BITS * order)) | context) << _SYMBOL_BITS) | symbol


def windows(data: np.ndarray, offsets: np.ndarray, order: int):
    """Distinct windows, which of them each symbol has, and where urls begin."""
    out, at = symbols(data, offsets)
    *_, longest = grams(out, at, order)
    return *np.unique(longest, return_inverse=True), at


def _even(n: int) -> np.ndarray:
    return np.full((n, 2), 1.0 / _LETTERS)


def _difference(p: np.ndarray) -> np.ndarray:
    return np.log(p[:, 1]) - np.log(p[:, 0])


def _means(difference: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(difference, at[:-1]) / np.diff(at) if len(at) > 1 else np.zeros(0)


def fit(pages: DataFrame, *, url="url", rules=RULES, order=ORDER, limit=GRAMS) -> Markov:
    """Models from all urls with a rule's verdict (each distinct or repeated url as often as it occurs)."""
    spark = pages.sparkSession
    prepare(spark)
    whole = ruled(pages.select(F.coalesce(F.col(url), F.lit("")).alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))), rules)
    known = whole.where("ruling is not null").select("url", (F.col("ruling") == "allow").cast("int").alias("label"), F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(CALIBRATE)).alias("fold"))

    def count(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            label = np.asarray(batch.column(1))
            for a, b in slices(offsets, SLICE):
                part = offsets[a : b + 1]
                out, at = symbols(data[part[0] : part[-1]], part - part[0])
                kind = np.repeat(label[a:b], np.diff(at))
                for occurring in grams(out, at, order):
                    gram, place = np.unique(occurring, return_inverse=True)
                    of_class = [np.bincount(place[kind == c], minlength=len(gram)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(gram), *map(pa.array, of_class)], ["gram", "rejected", "accepted"])

    counted = known.where("fold <> 0").select("url", "label").mapInArrow(count, "gram long, rejected long, accepted long")
    counted = materialize(counted.groupBy("gram").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted")), "url-grams")
    both = F.col("rejected") + F.col("accepted")
    sizes = {r["size"]: r["n"] for r in counted.groupBy(F.floor(F.log2(both)).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least = next(s for s in range(max(sizes, default=0) + 2) if sum(n for size, n in sizes.items() if size >= s) <= limit)
    if least == 0:
        model = Markov(*_gathered(counted), order)
        release(counted)
    else:
        low = Markov(*_gathered(counted.where(F.col("gram") < LOW_ORDERS << (_SYMBOL_BITS * (order + 1)))), order)
        kinds = [F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in _CLASSES]
        contexts = counted.groupBy(F.shiftright("gram", _SYMBOL_BITS).alias("gram")).agg(*[F.sum(c).alias(c) for c in _CLASSES], *kinds, F.max(both).alias("most"))
        contexts = contexts.where(F.col("most") >= 1 << least).drop("most").toArrow()
        rank = np.argsort(contexts.column("gram").to_numpy())
        number, *columns = (contexts.column(c).to_numpy()[rank] for c in ("gram", *_CLASSES, *(f"{c}_kinds" for c in _CLASSES)))
        totals = np.stack(columns[:2], axis=1).astype(np.float64), np.stack(columns[2:], axis=1).astype(np.float64)
        model = Markov(*_gathered(counted.where(both >= 1 << least)), order, contexts=(number, *totals), rest=Rest(counted, sum(sizes.values()), low))
    model.cut = _calibrated(known.where("fold = 0").select("url", "label"), model)
    return model


_CLASSES = ("rejected", "accepted")


def _gathered(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = counted.toArrow()
    keys = table.column("gram").to_numpy()
    rank = np.argsort(keys)
    return keys[rank], np.stack([table.column(c).to_numpy()[rank] for c in _CLASSES], axis=1).astype(np.float64)


def scored(rows: DataFrame, model: Markov) -> DataFrame:
    """``rows`` with ``score`` in place of ``url``: the mean difference per symbol less the threshold."""
    spark = rows.sparkSession
    others = [c for c in rows.columns if c != "url"]
    schema = StructType([f for f in rows.schema.fields if f.name != "url"] + [StructField("score", DoubleType())])
    rest, cut = model.rest, model.cut
    alone = copy.copy(model)
    alone.rest = None
    held = spark.sparkContext.broadcast(alone)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("url"))
            value = np.zeros(len(offsets) - 1)
            for a, b in slices(offsets, SLICE):
                part = offsets[a : b + 1]
                value[a:b] = held.value.per_symbol(data[part[0] : part[-1]], part - part[0]) - cut
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(value)], [*others, "score"])

    if rest is None:
        return rows.mapInArrow(run, schema)

    def listed(batches):
        """Of each part, the windows that are not held, one a row, and its urls with references to their windows' values."""
        part = TaskContext.get().partitionId() << 24
        for table in _together(batches):
            data, offsets = text_buffer(table.column("url"))
            window, place, at = windows(data, offsets, held.value.order)
            asked = ~held.value.held(window)
            value = np.full(len(window), np.nan)
            value[~asked] = held.value.values(window[~asked])
            wanted = window[asked]
            for a in range(0, len(wanted), 1 << 16):
                n = len(wanted[a : a + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(wanted[a : a + n]), *[pa.nulls(n, pa.binary())] * 4], _PART_NAMES)
            sink = pa.BufferOutputStream()
            kept = table.select(others)
            with pa.ipc.new_stream(sink, kept.schema) as out:
                out.write_table(kept)
            blobs = sink.getvalue().to_pybytes(), pack(value), pack(place.astype(np.int32)), pack(at)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([None], pa.int64()), *[pa.array([x], pa.binary()) for x in blobs]], _PART_NAMES)
            part += 1

    def joined(key, left, right):
        if not left.num_rows:
            return pa.Table.from_batches([], arrow)
        r = left.to_pylist()[0]
        value, place, at = unpack(r["known"], np.float64).copy(), unpack(r["refs"], np.int32), unpack(r["places"], np.int64)
        value[np.isnan(value)] = np.asarray(right.column("value"))[np.argsort(np.asarray(right.column("window")))]
        table = pa.ipc.open_stream(r["urls"]).read_all()
        return table.append_column("score", pa.array(_means(value[place], at) - cut)).cast(arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    parted = materialize(rows.mapInArrow(listed, "part long, window long, urls binary, known binary, refs binary, places binary"), "url-parts")
    pairs = parted.where("window is not null").select("part", "window")
    # written, so that the join back is of plain shuffles and can be split at a window that every part has
    values = materialize(_rest_values(pairs, rest, model.order), "url-values")
    found = pairs.join(values, "window").select(F.col("part").alias("of_part"), "window", "value")
    return again(parted).where("urls is not null").select("part", "urls", "known", "refs", "places").groupBy("part").cogroup(found.groupBy("of_part")).applyInArrow(joined, schema)


_PART_NAMES = ["part", "window", "urls", "known", "refs", "places"]


def _together(batches):
    """Batches joined until their urls have about PART_BYTES; none is empty."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column("url"))).as_py() or 0
        if size >= PART_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _rest_values(pairs: DataFrame, rest: Rest, order: int) -> DataFrame:
    """``window, value`` of the distinct windows in ``pairs``, from all grams.

    A window's grams of LOW_ORDERS and longer have the same LOW_ORDERS symbols before the last,
    and so do all grams of their contexts: they meet in one shard.
    """
    spark = pairs.sparkSession
    shards = -(-max(rest.size, pairs.count(), 1) // SHARD)
    low = spark.sparkContext.broadcast(rest.low)

    def shard(column: str) -> Column:
        shared = F.shiftright(column, _SYMBOL_BITS).bitwiseAND(F.lit((1 << (_SYMBOL_BITS * LOW_ORDERS)) - 1))
        return F.pmod(F.xxhash64(shared), F.lit(shards)).alias("shard")

    def valued(key, left, right):
        window = np.asarray(left.column("window"))
        if not len(window):
            return pa.table({"window": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        keys = np.asarray(right.column("gram"))
        rank = np.argsort(keys)
        counts = np.stack([np.asarray(right.column(c))[rank] for c in _CLASSES], axis=1).astype(np.float64)
        p = low.value.blended(window, _even(len(window)), range(min(LOW_ORDERS, order + 1)))
        p = Markov(keys[rank], counts, order).blended(window, p, range(LOW_ORDERS, order + 1))
        return pa.table({"window": pa.array(window), "value": pa.array(_difference(p))})

    asked = pairs.select("window").distinct().select("window", shard("window"))
    longer = rest.table.where(F.col("gram") >= LOW_ORDERS << (_SYMBOL_BITS * (order + 1))).select("*", shard("gram"))
    return asked.groupBy("shard").cogroup(longer.groupBy("shard")).applyInArrow(valued, "window long, value double")


def _calibrated(known: DataFrame, model: Markov) -> float:
    """The threshold with the smallest mean error of both classes, from a histogram of held-back scores."""
    before = written(known.sparkSession)
    place = F.least(F.greatest(F.rint(F.col("score") * 200), F.lit(-4000)), F.lit(4000)).cast("int")
    bins = scored(known, model).groupBy(place.alias("bin"), "label").agg(F.count(F.lit(1)).alias("n")).collect()
    discard(known.sparkSession, before)
    if len({r["label"] for r in bins}) < 2:
        return 0.0
    n = np.zeros((2, 8001))
    for r in bins:
        n[r["label"], r["bin"] + 4000] = r["n"]
    n /= n.sum(axis=1, keepdims=True)
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(n, axis=1)], axis=1)
    error = below[1] + 1 - below[0]  # allowed ones under the cut, blocked ones at or over it
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float((best[np.argmin(np.abs(best - best.mean()))] - 0.5 - 4000) / 200)


def judge(pages: DataFrame, *, page_id="page_id", url="url", rules=RULES, model: Markov | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every url.

    ``score`` is the length-normalised log-likelihood difference less the threshold; without
    a rule a url is allowed if it is 0 or more. A null url, or one without ``://``, has an
    empty host and path, no rule, and a score like any text. If rules accept or reject no url
    at all, scores are those of untrained models: 0, which allows. A score of 0 exactly allows.
    A null page_id stays null; urls of any length are read whole. Rows that repeat stay.
    """
    prepare(pages.sparkSession)
    model = model or fit(pages, url=url, rules=rules)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    rows = ruled(rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))), rules)
    verdict = F.coalesce("ruling", F.when(F.col("score") >= 0, "allow").otherwise("block"))
    return scored(rows.select("page_id", "url", "host", "path", "rule", "ruling"), model).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("page_id", "host", "path", "rule", "verdict")
