"""Near duplicates, repeated passages and packing against brute force, and the pipeline's contract."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkmill.llm import common, neardup, packing, sentences, toxicity

VOCABULARY = [a + b for a in ("ba", "do", "ki", "lu", "me", "no", "pa", "ru", "si", "tu") for b in ("n", "r", "s", "l", "m", "x")]


def prose(rng, n):
    out, k = [], 0
    while k < n:
        size = min(n - k, rng.randint(3, 12))
        out.append(" ".join(rng.choice(VOCABULARY) for _ in range(size)).capitalize() + rng.choice([". ", ".\n", "! ", "? "]))
        k += size
    return "".join(out)


def edited(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


def collection(seed=4):
    rng = random.Random(seed)
    texts = [None, "", "...", "one", "One!", "two words", "two words", "a b c d e", "A, b. c d e"]
    for k in range(25):
        base = prose(rng, rng.randint(60, 200))
        texts += [base] + [edited(rng, base, rng.choice([0, 1, 2, 3, 5, 8])) for _ in range(rng.randint(0, 6))]
    base, shared = prose(rng, 120), prose(rng, 80)
    texts += [edited(rng, base, rng.choice([0, 1, 2])) for _ in range(90)]  # a large group of near copies
    texts += [prose(rng, 60) + shared + prose(rng, 50) for _ in range(90)]  # a passage that many share
    texts += [prose(rng, 40000)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("small,block,depth", [(250, 250, 6), (8, 16, 3)])
def test_near_duplicates(docs_of, small, block, depth):
    texts = collection()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.near_duplicates(docs_of(texts), small=small, block=block, depth=depth).collect()}
    assert got == brute.classes(list(enumerate(texts)))


def test_near_duplicates_at_the_edges(docs_of):
    assert neardup.near_duplicates(docs_of(["a"]).limit(0)).count() == 0
    rows = neardup.near_duplicates(docs_of(["a b", "a b", "a b", None, ""], [7, 7, None, None, 9])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in rows if r["doc_id"]) == [(False, 7, 7, 1), (False, 7, 7, 1), (False, 9, 9, 0)]
    assert sum(r["doc_id"] is None and r["class_id"] is None and r["n_links"] == 0 for r in rows) == 2


def test_connected_classes(spark):
    rng = random.Random(2)
    edges = [(k, k - 1) for k in range(1, 60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(5, 5)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in neardup.connect(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(find(n) == r for n, r in got.items()) and all(n in got or find(n) == n for n in list(root))


def test_runs_follow_recall():
    assert neardup.runs_for(0.8, 0.99) < neardup.runs_for(0.8, 0.9999)
    assert (1 - 0.8 * neardup.survival(neardup.DEPTH - 1)) ** neardup.runs_for(0.8, neardup.RECALL) <= 1 - neardup.RECALL
    split = neardup.roots(0.8, 20)
    assert {r for r, _ in split} == set(range(20)) and len(split) >= 20


def test_deep_splits_lose_few_links(docs_of):
    """Pairs near the threshold whose every bucket is split three times more: recall against brute force."""
    rng = random.Random(21)
    shared, texts = prose(rng, 55), []
    for _ in range(120):
        own = prose(rng, 60)
        texts += [shared + own, shared + edited(rng, own, 2)]
    sets = [brute.shingles(t) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) > 80
    got = neardup.near_duplicates(docs_of(texts), small=3, block=8, depth=neardup.DEPTH, dense=2.0).collect()
    assert sum(r["n_links"] for r in got) >= 0.97 * 2 * len(want)


def test_a_long_chain_of_links_is_one_class(spark):
    n = 3000
    rows = neardup.connect(spark.createDataFrame([(k, k - 1) for k in range(1, n)], "a long, b long")).collect()
    assert len(rows) == n - 1 and {r["root"] for r in rows} == {0}


@pytest.mark.parametrize("block", [sentences.BLOCK, 3000])
def test_repeated_passages(docs_of, block):
    texts = collection(9)
    rows = {r["doc_id"]: r for r in sentences.dedup(docs_of(texts), block=block).collect()}
    gone = brute.removed(list(enumerate(texts)))
    for i, t in enumerate(texts):
        assert rows[i]["n_sentences"] == len(brute.sentences(t)) and rows[i]["n_removed"] == len(gone[i]), i
        kept = [w for k, s in enumerate(brute.sentences(t)) if k not in gone[i] for w in s]
        assert brute.words(rows[i]["text"]) == kept
        if not gone[i]:
            assert rows[i]["text"] == t
    assert sum(bool(g) for g in gone.values()) > 100
    assert sentences.dedup(docs_of(["a"]).limit(0)).count() == 0


def test_texts_that_share_an_id_and_rows_that_repeat(docs_of):
    rng = random.Random(6)
    a, b, c, d = (prose(rng, 100) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (2, b), (2, b), (3, c), (3, c + d), (3, d), (None, d), (None, None), (None, ""), (4, None), (4, None)]
    got = Counter((r["doc_id"], r["text"]) for r in sentences.dedup(docs_of([t for _, t in rows], [i for i, _ in rows])).collect())
    assert got[1, a] == 1 and got[2, b] == 1 and got[2, ""] == 3 and got[None, ""] == 2 and got[4, None] == 2 and got[None, None] == 1
    left = [t for (i, t), n in got.items() for _ in range(n) if i == 3]
    assert len(left) == 3 and Counter(w for t in left for w in brute.words(t)) == Counter(brute.words(c + d))  # each passage stays once
    # each (id, text) as a document of its own, against brute force
    texts = collection(12)
    ids = [rng.choice([1, 2, 3, None, 1000 + k]) for k in range(len(texts))]
    out = [(r["doc_id"], r["n_removed"]) for r in sentences.dedup(docs_of(texts, ids)).collect()]
    assert len(out) == len(texts) and Counter(i for i, _ in out) == Counter(ids)
    named = {1000 + k: t for k, (i, t) in enumerate(zip(ids, texts)) if i == 1000 + k}
    content = Counter(s for t in set(t for t in texts if t) for s in set(brute.spans(t).values()))
    for i, n in out:
        if i in named and named[i] and texts.count(named[i]) == 1 and all(content[s] == 1 for s in brute.spans(named[i]).values()) and len(brute.spans(named[i]).values()) == len(set(brute.spans(named[i]).values())):
            assert n == 0  # nothing that occurs once is removed


def test_hashes_that_no_input_breaks():
    morse = [bin(k).count("1") % 2 for k in range(4096)]
    one, two = (bytes(97 + (b ^ x) for b in morse) for x in (0, 1))
    data = np.frombuffer(one + two, np.uint8)
    starts, ends = np.array([0, 4096]), np.array([4096, 8192])
    assert len(set(common.run_hashes(data, starts, ends).tolist())) == 1  # what a polynomial modulo 2**64 alone can't tell apart
    assert len(set(common.word_hashes(data, starts, ends).tolist())) == 2
    values = np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64)
    base, prime = int(common._ROOT), int(common._PRIME)
    got = common.prime_hashes(values, np.array([0, 17, 4000]), np.array([5, 900, 5000]))
    assert got.tolist() == [sum((int(v) % prime + 1) * pow(base, k, prime) for k, v in enumerate(values[a:b])) % prime for a, b in ((0, 5), (17, 900), (4000, 5000))]


def test_passages_leave_no_second_copy(docs_of):
    rng = random.Random(5)
    shared = [prose(rng, 55) for _ in range(4)]
    texts = [prose(rng, 90) + shared[k % 4] + prose(rng, 90) for k in range(40)]
    out = [r["text"] for r in sentences.dedup(docs_of(texts)).orderBy("doc_id").collect()]
    for k, s in enumerate(shared):
        assert [i for i, t in enumerate(out) if s in t] == [k]


def running(rng, n, least, most):
    """``n`` words in sentences of ``least`` to ``most`` words."""
    out = []
    while len(out) < n:
        size = rng.randint(least, most)
        out += [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(size)]
        out[-1] += "."
    return out[:n]


@pytest.mark.parametrize("least,most", [(3, 12), (8, 16), (13, 30), (60, 90), (10**4, 10**4)])
def test_passages_of_51_words_at_any_place(docs_of, least, most):
    rng = random.Random(least)
    texts = []
    for k in range(40):
        passage = running(rng, 400, least, most)[(p := rng.randrange(300)) : p + 51]
        for _ in range(3):
            lead, rest = running(rng, rng.randint(1, 70), least, most), running(rng, rng.randint(1, 70), least, most)
            texts.append(" ".join(lead + passage + rest))
    rows = sentences.dedup(docs_of(texts)).orderBy("doc_id").collect()
    caught = [r["n_removed"] > 0 for r in rows]
    assert not any(caught[::3]) and sum(caught) >= 0.97 * 80
    assert all(r["text"] == t for i, (r, t) in enumerate(zip(rows, texts)) if i % 3 == 0)


def test_a_word_over_and_over(docs_of):
    rows = sentences.dedup(docs_of(["so " * 500, "x " + "so " * 100])).orderBy("doc_id").collect()
    assert [len(r["text"].split()) for r in rows] == [44, 29] and [r["n_removed"] for r in rows] == [19, 3]


def placed(docs, **options):
    return [r.asDict() for r in packing.pack(docs, **options).collect()]


def test_packing(docs_of, spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [None, "", " ", "\n\n a", "x\ty z", "don't 's \u00a0 ok", "<|endoftext|> b", "tail   "] + [prose(rng, rng.randint(1, 900)) for _ in range(150)] + ["same words here"] * 40 + [prose(rng, 9000)]
    rows = placed(docs_of(texts))
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    whole = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, ids in whole.items():
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in pieces] == packing.cut(len(ids))
        assert b"".join(r["ids"] for r in pieces) == np.array(ids, "<u4").tobytes()
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in pieces)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    assert len(by_sequence) <= 1.03 * sum(map(len, whole.values())) / packing.CAPACITY + 1
    packed = packing.sequences(packing.pack(docs_of(texts))).collect()
    assert sum(r["n_ids"] for r in packed) == sum(map(len, whole.values())) and all(len(r["ids"]) == 4 * r["n_ids"] for r in packed)
    assert packing.pack(docs_of(["a"]).limit(0)).count() == 0


def test_a_task_leaves_no_freed_memory_in_its_worker(spark):
    def resident():
        return next(int(line.split()[1]) for line in open("/proc/self/status") if line.startswith("VmRSS")) // 1024

    def run(batches):
        for batch in batches:
            held = [bytes([65 + k % 20]) * 5000 for k in range(40000)]
            pins.append(held[-1])  # what stays at the heap's end keeps the allocator from returning the rest
            del held
            yield batch

    pins = []
    before = resident()
    assert list(common.tidied(run)([1, 2])) == [1, 2]
    assert resident() < before + 60  # 200 MB without giving back
    sources = [toxicity.kept(docs, toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -1.0)) for docs in [spark.createDataFrame([(1, "a b c")], "doc_id long, text string")]]
    assert [r["text"] for r in sources[0].collect()] == ["a b c"]


def test_tidying_gives_back_the_drivers_freed_memory(spark):
    def resident():
        return next(int(line.split()[1]) for line in open("/proc/self/status") if line.startswith("VmRSS")) // 1024

    before, pins = resident(), []
    for _ in range(2):
        held = [bytes([65 + k % 20]) * 5000 for k in range(40000)]
        pins.append(held[-1])
        del held
    common.tidy(spark)
    assert resident() < before + 60  # 200 MB without giving back


def test_pieces_are_encoded_once_whatever_signs_follow(monkeypatch):
    encode, asked = packing.Encoder(packing.default_tokenizer()), []
    learn = encode._learn
    monkeypatch.setattr(encode, "_learn", lambda pieces: asked.extend(pieces) or learn(pieces))
    words = [f" {a}{b}" for a in VOCABULARY for b in VOCABULARY[:10]]
    encode(["".join(w + sign for w in words) for sign in (",", ".", ";", "?!", "'s", " 12.5")])
    assert len(asked) <= len(words) + 10  # 3,600 with a word and what follows it as one piece
    encode(["".join(words)])
    assert len(asked) <= len(words) + 10


def test_encoder_equals_tokenizer_on_odd_texts_and_with_little_memory(monkeypatch):
    rng = random.Random(4)
    signs = [*"ab'sStrelvmd|<>12 \n\u00e9.,-\t\u65e5\u00df\u00b2\u2167_\u0301\x00\x1c\x85\u00a0\u3000\u2019", "<|endoftext|>", "'s", "'ll", "  ", "<|", "|>", "x" * 70]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(4000)]
    expected = [np.array(e.ids, "<u4").tobytes() for e in packing.Encoder(packing.default_tokenizer()).tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert packing.Encoder(packing.default_tokenizer())(texts) == expected
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 5000)
    monkeypatch.setattr(packing, "SLICE", 1000)
    encode = packing.Encoder(packing.default_tokenizer())
    assert encode(texts) == expected
    assert encode.known.nbytes + encode.ids.nbytes + encode.first.nbytes + encode.count.nbytes <= 5100


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_each_rank_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 2048])
    sizes = Counter(min(capacity, max(1, int(rng.choice([rng.randint(1, capacity), rng.gauss(capacity / 3, capacity / 20), capacity, 1])))) for _ in range(rng.choice([1, 7, 300, 20000])))
    for groups in (3, 24):
        n, rows = packing.plan(sizes, groups, capacity)
        ranks, use = defaultdict(list), defaultdict(list)
        for length, start, count, first, offset in rows:
            ranks[length].append((start, count))
            for k in range(count):
                use[first + k].append((offset, length))
        assert {k: sum(c for _, c in v) for k, v in ranks.items()} == sizes and sorted(use) == list(range(n))
        for v in ranks.values():
            at = 0
            for start, count in sorted(v):
                assert start == at
                at += count
        for v in use.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= capacity


def test_configurations_are_optimal():
    basis = packing.configurations([60, 50, 40, 30], [10, 10, 10, 10], 100)
    assert abs(sum(t for _, t in basis) - 18.3333) < 0.2  # 60+40, 50+50, 30*3
    made = np.sum([np.array(c) * t for c, t in basis], axis=0)
    assert np.allclose(made, 10)


def test_pipeline(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    before = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(k)))
        back = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert back.columns == docs.columns and dict(back.dtypes) == dict(docs.dtypes), name
            ids = {r["doc_id"] for r in back.select("doc_id").collect()}
            assert before is None or ids <= before
            before = ids
            docs = back
    rows = back.collect()
    assert {r["doc_id"] for r in rows} == before
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert all(c == i for i, (c, _) in brute.classes(texts).items())  # redaction aside, nothing similar is left
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert not any(brute.contaminated(t, items)[1] for _, t in texts)
    assert not any(brute.secrets(t) for _, t in texts)


def test_pipeline_stages_on_odd_rows(spark, docs_of, tmp_path):
    docs = docs_of([None, "", "same words again and again", "same words again and again", "password=abcdefgh", "x" * 50], [1, None, 3, 4, None, 6])
    for k in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{k}.parquet").limit(0 if k == "labels" else 5).write.parquet(str(tmp_path / f"{k}.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            n = out.count()
            assert n == (5 if name == "ngram_jaccard" else 6) * (rows is docs), name
            if name != "packing":
                assert out.columns == docs.columns
    assert corpus_pipeline.keep_one_of_each(spark, docs, "").where(F.col("doc_id") == 4).count() == 0


def test_pipeline_keeps_one_row_of_each_class(spark, docs_of):
    rng = random.Random(8)
    a, b, c, d, e = (prose(rng, 120) for _ in range(5))
    rows = [(5, a), (5, a), (5, a), (None, a), (None, b), (None, b), (7, c), (7, d), (3, c), (9, e), (None, ""), (2, None)]
    kept = corpus_pipeline.keep_one_of_each(spark, docs_of([t for _, t in rows], [i for i, _ in rows]), "")
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(5, a), (None, b), (7, d), (3, c), (9, e), (None, ""), (2, None)])
