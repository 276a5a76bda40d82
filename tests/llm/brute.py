"""Plain versions of what the operators compute, straight from their definitions."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from larkmill.llm import common

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def contaminated(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, item_text in items:
        v = words(item_text)
        for k in range(max(1, len(v) - 9) if v else 0):
            window = v[k : k + 10]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def secrets(text):
    """Base findings by the patterns alone."""
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[0]) >= least]
    return sorted(out)


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def classes(rows, threshold=0.8):
    """class and number of links of each (id, text) with an id; ids are distinct."""
    sets = {i: shingles(t) for i, t in rows}
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common and common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-12:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (find(i), links[i]) for i in ids}


def sentences(text, longest=24, radius=3, apart=4):
    """The sentences of a text as tuples of words, long ones parted at words with the least hash around."""
    out, at = [], 0
    for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw := (text or "").encode().translate(LOWER)):
        gap = raw[at : m.start()]
        broken = any((gap[k : k + 1] in (b".", b"!", b"?") and gap[k + 1 : k + 2] in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) or gap[k : k + 1] == b"\n" for k in range(len(gap)))
        if broken or not out:
            out.append([])
        out[-1].append(m[0])
        at = m.end()
    flat = [w for s in out for w in s]
    value, k, pieces = [word_hash(w) for w in flat], 0, []
    for s in out:
        for j, w in enumerate(s):
            around = value[max(0, k - radius) : k] + value[k + 1 : k + radius + 1]
            if not j or (apart <= j <= len(s) - apart and all(value[k] < v for v in around)):
                pieces.append([])
            pieces[-1].append(w)
            k += 1
    return [tuple(p[k : k + longest]) for p in pieces for k in range(0, len(p), longest)]


@functools.cache
def word_hash(word):
    data = np.frombuffer(word, np.uint8)
    return int(common.word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def spans(text, least=3, least_words=20):
    s = sentences(text)
    found = set()
    for i in range(len(s)):
        for j in range(i + least, len(s) + 1):
            if sum(map(len, s[i:j])) >= least_words:
                found.add((i, j))
                break
    for j in range(1, len(s) + 1):
        for i in range(j - least, -1, -1):
            if sum(map(len, s[i:j])) >= least_words:
                found.add((i, j))
                break
    return {(i, j): tuple(s[i:j]) for i, j in found}


def removed(rows):
    """Sentences to remove of each (id, text)."""
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for (a, b), content in sorted(spans(t).items()):
            first[content] = min(first.get(content, (i, a)), (i, a))
    return {i: {k for (a, b), content in spans(t).items() if first[content] != (i, a) for k in range(a, b)} for i, t in rows}


def base_scores(rows, held_out):
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)) + [None] for i, t in rows}
    count = Counter(w for i, w in tokens.items() if not held_out(i) for w in w)
    n, v = sum(count.values()), len(count)
    return {i: (len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


def fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, None
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.encode().translate(LOWER).decode()
    best = None
    for what, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (what, rule)
    return host, path, best and best[1], best and best[0]
