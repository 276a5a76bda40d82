"""Near-duplicate links by a chosen-path similarity join, and the classes they form.

A document is the set of its five-word shingles (A-Z lowered); a shorter one with at least
one word is a single shingle. Documents with equal sets form one *node*, so exact copies are
never compared. Nodes are embedded by MinHash: ``COORDINATES`` shingles each, of which a
chosen-path join of ``runs`` independent trees finds nodes of similarity ``threshold``:

* at the root a run picks coordinates with probability 1/(threshold * COORDINATES) each and
  splits all nodes by their shingle there; a bucket that is still large is split again by
  tokens (coordinate, value) that a hash of the path picks at the same rate, so that a pair
  at the threshold is expected to stay together once at each level;
* a small bucket is compared by brute force. A bucket that stops shrinking, or is large at
  the deepest level, holds mutually similar nodes: it is compared exactly as well, block
  against block, each pair of blocks a task's group of bounded size. Nodes that were together
  in such a bucket of another run already are not compared again;
* runs are repeated until a pair at the threshold is missed with probability below
  1 - ``recall`` even where its bucket is split to the deepest level. Below the root every
  run picks its own tokens, so runs that split the same coordinate are independent there.

Comparison is by sketches of one byte per coordinate first, and pairs that pass are verified
with their whole shingle sets. A pair that shares several paths is verified and counted only
at the least of them, so neither pairs nor their repetitions are ever written out: tasks
return each node's number of partner documents and the local class it belongs to. Counting
the links within a group of mutually similar, different texts takes work with the square of
their number (copies are one node and take none). Classes are connected by alternating star
contraction, in Spark, never on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD, materialize, mix64, parts, prepare, release, slices, text_buffer, tidied, tidy, word_hashes, word_runs

SHINGLE = 5
THRESHOLD = 0.8
#: Of pairs at the threshold, wherever their buckets are split to the deepest level; of others more.
RECALL = 0.99
COORDINATES = 128
#: Buckets of up to so many nodes are compared at once; larger ones are split.
SMALL = 250
#: Nodes of a block, of buckets that don't split.
BLOCK = 250
DEPTH = 6
#: A bucket that keeps this share of the one that it was split from doesn't split.
DENSE = 0.6
SEED = 20_240_917
SLICE = 1 << 20
#: Pairs whose sketches agree less than this (four standard errors under the threshold) are not verified.
_MARGIN = 4.0

_A = np.random.default_rng(SEED).integers(1, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_X = np.random.default_rng(SEED + 1).integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)


def survival(splits: int) -> float:
    """Probability that a pair at the threshold, expected to stay together once at each split, still is somewhere after so many."""
    left = 1.0
    for _ in range(splits):
        left = 1 - math.exp(-left)
    return left


def runs_for(threshold: float, recall: float, splits: int = DEPTH - 1) -> int:
    """Independent runs that leave a pair at the threshold unfound with probability 1 - recall, if all of its buckets are split so often below the root."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold * survival(splits))))


def roots(threshold: float, runs: int) -> list[tuple[int, int]]:
    """(run, coordinate) of the root's splits: each run picks its own, one at least."""
    rng = np.random.default_rng(SEED + 2)
    out = []
    for run in range(runs):
        picked = np.flatnonzero(rng.random(COORDINATES) < 1 / (threshold * COORDINATES))
        out += [(run, int(c)) for c in (picked if len(picked) else rng.choice(COORDINATES, 1))]
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """Shingle hashes of all texts, in order, and where each text's begin."""
    low = LOWER[data]
    starts, ends, before = word_runs(low, WORD, offsets)
    words = word_hashes(low, starts, ends)
    n_words = np.diff(before)
    count = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(count)), count)
    first = before[:-1][text] + np.arange(at[-1]) - at[text]
    value = np.zeros(len(first), np.uint64)
    left = before[1:][text] - first
    for k in range(size):
        there = left > k
        value = np.where(there, (value + words[np.minimum(first + k, max(len(words) - 1, 0))]) * np.uint64(0x9FB21C651E98DF25) if len(words) else value, value)
    return mix64(value), at


def embedded(values: np.ndarray) -> np.ndarray:
    """The shingle at every coordinate: that with the least of 32 permuted bits of its hash."""
    high = (values >> np.uint64(32)).astype(np.uint32)
    best, where = None, None
    for a in range(0, len(high), 8192):
        permuted = (high[a : a + 8192][None, :] ^ _X[:, None]) * _A[:, None]
        k = permuted.argmin(axis=1)
        least = permuted[np.arange(COORDINATES), k]
        if best is None:
            best, where = least, k
        else:
            better = least < best
            best, where = np.where(better, least, best), np.where(better, k + a, where)
    return values[where]


def sketch(chosen: np.ndarray) -> np.ndarray:
    return (mix64(chosen + np.arange(COORDINATES, dtype=np.uint64)) & np.uint64(255)).astype(np.uint8)


def node_key(own: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set of distinct shingle hashes."""
    one, two = (np.add.reduce(mix64(own ^ np.uint64(salt))) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    low, high = mix64(np.array([one + np.uint64(len(own)), two], np.uint64)).view(np.int64)
    return int(high), int(low)


_NODES = "doc_id long, high long, low long, sketch binary, paths array<long>"


def node_rows(docs: DataFrame, threshold: float, runs: int, size: int, doc_id: str, text: str) -> DataFrame:
    """Each document with the key of its shingle set, sketch and root paths; all null without words."""
    split = roots(threshold, runs)
    picked = np.array([c for _, c in split])
    salt = mix64(np.arange(1, len(split) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches):
        for batch in parts(batches, 1, SLICE):
            data, offsets = text_buffer(batch.column(1))
            value, at = shingles(data, offsets, size)
            keys, sketches, paths = [], [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                if i == j:
                    keys.append((None, None)), sketches.append(None), paths.append(None)
                    continue
                own = np.unique(value[i:j])
                chosen = embedded(own)
                keys.append(node_key(own))
                sketches.append(sketch(chosen).tobytes())
                paths.append(mix64(chosen[picked] ^ salt).astype(np.int64))
            high, low = zip(*keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sketches, pa.binary()), pa.array(paths, pa.list_(pa.int64()))], ["doc_id", "high", "low", "sketch", "paths"])

    return docs.select(F.col(doc_id).cast("long").alias("near_id"), F.col(text).alias("near_text")).mapInArrow(tidied(run), _NODES)


def _split(threshold: float, level: int):
    """Child paths of (path, node, sketch) rows."""
    limit = np.uint64(int(2**64 / (threshold * COORDINATES)))
    place = np.arange(COORDINATES, dtype=np.uint64) * np.uint64(256)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            path = np.asarray(batch.column("path")).view(np.uint64)
            own = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            salted = mix64(path + np.uint64(level))
            for a in range(0, len(path), 4096):
                token = mix64(salted[a : a + 4096, None] + place + own[a : a + 4096])
                row, c = np.nonzero(token < limit)
                child = mix64(token[row, c] ^ salted[a : a + 4096][row]).astype(np.int64)
                k = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([pa.array(child), batch.column("node").take(k), batch.column("size").take(k)], ["path", "node", "parent_size"])

    return run


def leaves(nodes: DataFrame, threshold: float, small: int, depth: int, dense: float) -> DataFrame:
    """``path, node, size`` of every bucket that is to be compared."""
    rows = nodes.select(F.explode("paths").alias("path"), "node", F.lit(None).cast("long").alias("parent_size"))
    done: list[DataFrame] = []
    for level in range(1, depth + 1):
        if level > 1:
            rows = materialize(rows.dropDuplicates(["path", "node"]), "paths")
        # both written, so that the join is of plain shuffles and can be split at a large bucket
        sizes = materialize(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        sized = materialize(rows.join(sizes, "path"), "sized-paths")
        release(sizes, rows)
        ends = F.col("size") <= small if level < depth else F.lit(True)
        stuck = F.coalesce(F.col("size") >= dense * F.col("parent_size"), F.lit(False))
        done.append(sized.where(ends | stuck).select("path", "node", "size"))
        more = sized.where(~(ends | stuck)).select("path", "node", "size")
        if level == depth or more.isEmpty():
            break
        held = more.join(nodes.select("node", "sketch"), "node")
        rows = held.mapInArrow(tidied(_split(threshold, level)), "path long, node long, parent_size long")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def blocks(rows: DataFrame, small: int, block: int) -> DataFrame:
    """One row for each group of nodes that are compared: ``path, one, two`` and the node's own block.

    Small buckets are one group; of others every pair of blocks is. A large bucket's nodes that
    were together in an earlier large one (that with the least path) are not compared with each
    other again, only with the rest.
    """
    lit = F.lit
    few = rows.where(F.col("size") <= 2 * small).select("path", lit(0).alias("one"), lit(0).alias("two"), lit(0).alias("own"), "node")
    large = rows.where(F.col("size") > 2 * small)
    earlier = large.groupBy("node").agg(F.min("path").alias("mark"))
    marked = materialize(large.select("path", "node").join(earlier, "node"), "near-large")
    known = marked.groupBy("path", "mark").agg(F.count(lit(1)).alias("n")).groupBy("path").agg(F.min("mark").alias("least"), F.min_by("n", "mark").alias("n"), F.sum("n").alias("size"))
    known = materialize(known.withColumn("n", F.when(F.col("least") < F.col("path"), F.col("n")).otherwise(0)), "near-known")

    def pieces(n):
        return F.ceil(n / block).cast("int")

    split = marked.join(known, "path").withColumn("old", (F.col("mark") == F.col("least")) & (F.col("n") > 0))
    split = split.withColumn("first", pieces(F.col("n"))).withColumn("rest", pieces(F.col("size") - F.col("n")))
    deal = F.xxhash64("node", "path")
    own = F.when(F.col("old"), F.pmod(deal, F.greatest("first", lit(1)))).otherwise(F.col("first") + F.pmod(deal, F.greatest("rest", lit(1)))).cast("int")
    low = F.when(F.col("old"), F.col("first")).otherwise(0)
    split = split.withColumn("own", own).where(low < F.col("first") + F.col("rest"))
    split = split.withColumn("other", F.explode(F.sequence(low, F.col("first") + F.col("rest") - 1)))
    return few.unionByName(split.select("path", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "node"))


def _groups(batches):
    """Whole groups of rows sorted by path, one, two: several at a time."""
    held = []
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < 4096:
            continue
        table = pa.concat_tables(held).combine_chunks()
        key = np.stack([np.asarray(table.column(c)) for c in ("path", "one", "two")])
        change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
        if not len(change):
            held = [table]
            continue
        yield table.slice(0, int(change[-1]) + 1)
        held = [table.slice(int(change[-1]) + 1)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _candidates(table: pa.Table, threshold: float):
    """Row pairs of one table that are in one group, pass the sketch test and share no lesser path."""
    n = table.num_rows
    key = np.stack([np.asarray(table.column(c)) for c in ("path", "one", "two", "own")])
    own = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
    lists = table.column("leaves").combine_chunks()
    values, at = np.asarray(lists.values), np.asarray(lists.offsets)
    least = COORDINATES * (threshold - _MARGIN * math.sqrt(threshold * (1 - threshold) / COORDINATES))
    change = np.concatenate([[True], (key[:3, 1:] != key[:3, :-1]).any(axis=0)])
    group = np.cumsum(change) - 1
    ends = np.append(np.flatnonzero(change)[1:], n)[group]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = np.arange(n)
    for d in range(1, int((ends - rows).max(initial=0))):
        i = rows[rows + d < ends]
        # blocks of one bucket: only pairs across, unless the group is one block with itself
        i = i[(key[1, i] == key[2, i]) | (key[3, i] != key[3, i + d])]
        for a in range(0, len(i), 8192):
            k = i[a : a + 8192]
            k = k[(own[k] == own[k + d]).sum(axis=1) >= least]
            left.append(k)
            right.append(k + d)
    left, right = np.concatenate(left), np.concatenate(right)
    keep = np.ones(len(left), bool)
    for a in range(0, len(left), 1 << 14):
        keep[a : a + (1 << 14)] = ~_meet_before(values, at, key[0], left[a : a + (1 << 14)], right[a : a + (1 << 14)])
    return left[keep], right[keep]


def _meet_before(values, at, path, left, right) -> np.ndarray:
    """Whether the rows of each pair share a leaf below the path of their group (lists are sorted)."""
    out = np.zeros(len(left), bool)
    rows, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    less = [values[at[k] : at[k] + np.searchsorted(values[at[k] : at[k + 1]], path[k])] for k in rows.tolist()]
    width = max((len(x) for x in less), default=0)
    if not width:
        return out
    held = np.zeros((len(rows), width), np.int64)
    size = np.array([len(x) for x in less])
    for k, x in enumerate(less):
        held[k, : len(x)] = x
    one, two = where[: len(left)], where[len(left) :]
    for c in range(width):
        for d in range(width):
            out |= (held[one, c] == held[two, d]) & (c < size[one]) & (d < size[two])
    return out


_WANTED = "path long, one int, two int, own int, node long"


def _sketched(threshold: float):
    def run(batches):
        for table in _groups(batches):
            left, right = _candidates(table, threshold)
            rows = np.unique(np.concatenate([left, right]))
            if len(rows):
                yield from table.select(["path", "one", "two", "own", "node"]).take(pa.array(rows)).to_batches()

    return run


_FOUND = "node long, links long, root long"


def _verified(threshold: float):
    """Exact links of each group: how many documents each node is linked with, and its least node of the group's class."""

    def run(batches):
        for table in _groups(batches):
            left, right = _candidates(table, threshold)
            if not len(left):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            common = _intersections(sets, left, right)
            size = np.array([len(s) for s in sets])
            linked = common >= threshold * (size[left] + size[right] - common) - 1e-9
            left, right = left[linked], right[linked]
            copies, node = np.asarray(table.column("copies")), np.asarray(table.column("node"))
            links = np.bincount(left, copies[right], table.num_rows) + np.bincount(right, copies[left], table.num_rows)
            root = node.copy()
            while True:
                before = root.copy()
                low = np.minimum(root[left], root[right])
                np.minimum.at(root, left, low)
                np.minimum.at(root, right, low)
                if np.array_equal(before, root):
                    break
            rows = np.flatnonzero(links > 0)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(links[rows].astype(np.int64)), pa.array(root[rows])], ["node", "links", "root"])

    return run


def _intersections(sets, left, right) -> np.ndarray:
    """Common shingles of each pair. Pairs come from groups; a dense group is counted by bit sets."""
    out = np.zeros(len(left), np.int64)
    order = np.lexsort((right, left))
    # consecutive pairs that touch overlapping rows form a patch
    at = 0
    while at < len(order):
        end, low, high = at, int(left[order[at]]), int(right[order[at]])
        while end < len(order) and int(left[order[end]]) <= high and int(left[order[end]]) - low < 2 * BLOCK:
            high = max(high, int(right[order[end]]))
            end += 1
        patch = order[at:end]
        rows = np.unique(np.concatenate([left[patch], right[patch]]))
        total = sum(len(sets[k]) for k in rows)
        if len(patch) > 4 * len(rows) and total < 2_000_000:
            out[patch] = _by_bits([sets[k] for k in rows], np.searchsorted(rows, left[patch]), np.searchsorted(rows, right[patch]))
        else:
            for p in patch.tolist():
                a, b = sets[left[p]], sets[right[p]]
                where = np.searchsorted(b, a)
                out[p] = (b[np.minimum(where, len(b) - 1)] == a).sum()
        at = end
    return out


def _by_bits(sets, left, right) -> np.ndarray:
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    owner, inverse = owner[shared], inverse[shared]
    _, inverse = np.unique(inverse, return_inverse=True)
    width = int(inverse.max(initial=-1)) + 1
    out = np.zeros(len(left), np.int64)
    for a in range(0, width, 1 << 16):
        here = (inverse >= a) & (inverse < a + (1 << 16))
        bits = np.zeros((len(sets), min(1 << 16, width - a)), bool)
        bits[owner[here], inverse[here] - a] = True
        packed = np.packbits(bits, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
        step = max(1, (1 << 22) // max(1, packed.shape[1]))
        for k in range(0, len(left), step):
            out[k : k + step] += np.bitwise_count(packed[left[k : k + step]] & packed[right[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


def _sets(size: int):
    """Shingle sets of wanted nodes; other texts that share an id are left out."""

    def run(batches):
        for batch in parts(batches, "text", SLICE):
            data, offsets = text_buffer(batch.column("text"))
            value, at = shingles(data, offsets, size)
            node, out = [], []
            for who, high, low, i, j in zip(*(batch.column(c).to_pylist() for c in ("node", "high", "low")), at[:-1].tolist(), at[1:].tolist()):
                own = np.unique(value[i:j])
                if len(own) and node_key(own) == (high, low):
                    node.append(who)
                    out.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(out, pa.binary())], ["node", "shingles"])

    return run


def connect(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge (``a``, ``b``): the least node it is connected with.

    Alternating large and small stars, each a minimum by node and a join back, until nothing
    changes; every round is written to the shared folder, and the one before it deleted.
    """
    now = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the joins back are of plain shuffles and split where a node has very many edges
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        # large star: the larger neighbours go to the least
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = materialize(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "down")
        low = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = materialize(small.where("a <> b").distinct(), "edges")
        release(now, least, down, low)
        now = after
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        state = seen


def near_duplicates(docs: DataFrame, *, threshold=THRESHOLD, recall=RECALL, size=SHINGLE, small=SMALL, block=BLOCK, depth=DEPTH, dense=DENSE, doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id, class_id, n_links`` of every document.

    Two documents are linked if the Jaccard similarity of their shingle sets is ``threshold``
    or more. ``n_links`` counts the other documents that one is linked with, ``class_id`` is
    the least id among all that it is connected with. Documents without words are linked with
    none; documents without an id are compared with none and have a null class. Rows that
    repeat count as copies; of texts that share an id each is compared, and each row gets the
    class of its text. Very long texts are compared whole; other columns are ignored. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    split = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    all_rows = materialize(node_rows(docs, threshold, runs_for(threshold, recall), size, doc_id, text), "near-documents")
    compared = all_rows.where("high is not null and doc_id is not null")
    same = compared.groupBy("high", "low").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    nodes = materialize(same.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    tidy(spark)
    leaf = materialize(leaves(nodes, threshold, small, depth, dense), "near-leaves")
    groups = blocks(leaf, small, block)
    known = leaf.groupBy("node").agg(F.sort_array(F.collect_set("path")).alias("leaves"))  # a few paths of each run
    profile = materialize(nodes.join(known, "node").select("node", "copies", "sketch", "leaves"), "near-profiles")
    tidy(spark)

    def arranged(rows: DataFrame) -> DataFrame:
        return rows.repartition(split, "path", "one", "two").sortWithinPartitions("path", "one", "two", "node")

    sketched = arranged(groups.join(profile.drop("copies"), "node"))
    wanted = materialize(sketched.select("path", "one", "two", "own", "node", "sketch", "leaves").mapInArrow(tidied(_sketched(threshold)), _WANTED), "near-wanted")
    release(leaf)
    tidy(spark)
    need = wanted.select("node").distinct().join(nodes.select("node", "high", "low", "first_id"), "node")
    texts = docs.select(F.col(doc_id).cast("long").alias("first_id"), F.col(text).alias("text"))
    held = texts.join(need, "first_id").select("node", "high", "low", "text").mapInArrow(tidied(_sets(size)), "node long, shingles binary")
    held = held.dropDuplicates(["node"])
    full = wanted.join(profile, "node").join(held, "node")
    found = materialize(arranged(full).select("path", "one", "two", "own", "node", "copies", "sketch", "leaves", "shingles").mapInArrow(tidied(_verified(threshold)), _FOUND), "near-links")
    release(wanted, profile)
    tidy(spark)
    classes = connect(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("high", "low", "node", "first_id", "copies").join(classes, "node", "left").join(links, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = named.join(least, "root").select("high", "low", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    # written, so that the join back can be split at a large group of copies
    named = materialize(named, "near-classes")
    linked = compared.select("doc_id", "high", "low").join(named, ["high", "low"]).select("doc_id", "class_id", "n_links")
    rest = all_rows.where("high is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(rest)
