"""Plain versions of the corpus operators, for small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def base_license(text):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    w, at, labels = words(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        if found:
            labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def contamination(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        b = words(item)
        n = min(10, len(b))
        for i in range(len(b) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item_id)
    ids = ",".join(sorted(str(x) for x in found if x is not None))
    return len(w), len(hit), hashlib.sha256(ids.encode()).hexdigest()


def shingles(text):
    w = words(text)
    if not w:
        return Counter()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def classes(texts, threshold=0.8):
    """The smallest index of the class of each text, by all pairs."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            total = sum((sets[i] | sets[j]).values())
            if total and sum((sets[i] & sets[j]).values()) / total >= threshold:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def repeated_bytes(texts, n=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - n + 1):
            if count[r[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def later_bytes(texts, n=200):
    """How many bytes of each text are in strings of ``n`` bytes that start earlier, in this order of texts."""
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - n + 1):
            if raw[i : i + n] in seen:
                gone[i : i + n] = [True] * n
            seen.add(raw[i : i + n])
        out.append(sum(gone))
    return out


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def line_dedup(docs):
    """``{doc_id: kept lines}`` of documents with unique ids; the null id comes last."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] if d[0] is not None else 0))
    seen, kept = [], {}
    for doc_id, text in order:
        kept[doc_id] = []
        for line in (text or "").split("\n"):
            w = words(line)
            if w and any(w == s or (len(w) >= 8 and len(s) >= 8 and within_one(w, s)) for s in seen):
                seen.append(w)
                continue
            seen.append(w)
            kept[doc_id].append(line)
    return kept


def targets(sizes):
    """``{source: target}`` by sharing out again until none is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def base_scores(docs):
    """``[(held_out, n_tokens, n_known, N, base_score)]``."""
    end, lists = object(), [tokens(t) for _, t in docs]
    count = Counter()
    for (doc_id, _), own in zip(docs, lists):
        if crc(doc_id) != 1:
            count.update([*own, end])
    n, v = sum(count.values()), len(count)
    out = []
    for (doc_id, _), own in zip(docs, lists):
        all_ = [*own, end]
        score = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in all_)
        out.append((crc(doc_id) == 1, len(all_), sum(count[t] > 0 for t in all_), n, score))
    return out


def nearest(vectors, k=20):
    """``{query id: [(id, score)]}`` over rows of ``(id, vector)`` that take part."""
    out = defaultdict(list)
    for q, v in vectors:
        if q % 20 == 0:
            all_ = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q))
            out[q] = [(i, -s) for s, i in all_[:k]]
    return out
