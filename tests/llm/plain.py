"""Brute-force forms of the operators, in plain Python."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def overlaps(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        words = LETTERS.findall(lower(text))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(str(item))
    out = []
    for doc, text in docs:
        words, hit, found = LETTERS.findall(lower(text)), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return out


def shingles(text, n=5):
    words = SPACED.findall(lower(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near_copies(docs, percent=80):
    sets = {d: shingles(t) for d, t in docs}
    ids, links = sorted(sets), []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                links.append((b, a))
    root = roots(ids, links)
    return [(d, len(sets[d]), root[d]) for d in ids]


def archive(pages):
    first = {}
    for page, _, text in sorted(pages):
        first.setdefault(text or "", page)
    out = []
    for page, _, text in pages:
        raw, origin = (text or "").encode(), first[text or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, *(("response", None) if origin == page else ("revisit", origin))))
    return out


def unigrams(docs, held_out):
    counts, texts = Counter(), {}
    for doc, text in docs:
        texts[doc] = [*SPACED.findall(lower(text)), None]
        if not held_out(doc):
            counts.update(texts[doc])
    total, distinct = sum(counts.values()), len(counts)
    share = lambda w: (counts[w] + 1) / (total + distinct + 1)
    return [(doc, len(words), sum(counts[w] > 0 for w in words), total, sum(math.log10(share(w)) for w in words))
            for doc, words in texts.items()]


def crc(doc, parts):
    return zlib.crc32(str(doc).encode()) % parts
