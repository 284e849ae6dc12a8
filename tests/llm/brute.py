"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(doc_id, n, r):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n == r


def suffix_dedup(docs, length=50):
    """[(doc_id, text)] to [(doc_id, n_bytes, n_removed, n_spans, sha)]."""
    owners = defaultdict(lambda: None)
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        if i is not None:
            for p in range(len(b) - length + 1):
                w = b[p : p + length]
                owners[w] = i if owners[w] is None else min(owners[w], i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - length + 1):
                if owners[b[p : p + length]] < i:
                    gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return out


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def jaccard_components(docs, threshold=75):
    """[(doc_id, text)] with distinct ids to {doc_id: (n, component)}."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    many, covered, seen, dup = Counter(tri), set(), set(), 0
    for k, t in enumerate(tri):
        if many[t] > 1:
            covered |= {k, k + 1, k + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def words(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]
