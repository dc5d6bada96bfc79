"""Plain re-computations of what the operators promise, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

_LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def words(text, lower=False):
    data = (text or "").encode()
    return (data.translate(bytes.maketrans(*_LOWER)) if lower else data).split()


def shingles(text, k):
    w = words(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, k, percent):
    """{id: (size, component)} for unique non-null ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]) and sets[y]:
                a, b = sorted((root(x), root(y)))
                low[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def cut(rows, window):
    """{id: (words, removed, digest)}."""
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                keep[s : s + window] = [False] * window
        kept = [x for x, k in zip(w, keep) if k]
        out[i] = len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()
    return out


def base_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if x.encode().split()]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 8)}
    return (
        len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered),
    )


def frequent_words(rows, limit):
    """{id: words in lines held by more than limit distinct documents of the host}."""
    def normal(line):
        return tuple(re.sub(rb"[0-9]", b"0", x) for x in words(line, lower=True))

    held = defaultdict(set)
    for _, host, text in rows:
        for line in (text or "").split("\n"):
            if normal(line):
                held[host, normal(line)].add(tuple(words(text)))
    return {
        i: sum(len(normal(x)) for x in (text or "").split("\n") if len(held[host, normal(x)]) > limit)
        for i, host, text in rows
    }


def profile(texts, size):
    grams = Counter()
    for text in texts:
        for word in re.sub(r"[\W\d_]+", " ", (text or "").lower()).split():
            for n, padded in ((1, word), (2, f" {word} "), (3, f" {word} ")):
                grams.update(padded[i : i + n] for i in range(len(padded) - n + 1))

    def number(g):
        value = 0
        for c in g:
            value = (value << 21) + ord(c)
        return value

    return sorted(grams, key=lambda g: (-grams[g], number(g)))[:size]


def language(text, profiles, size):
    top = profile([text], size)
    if not top:
        return "und", 0.0
    gaps = {}
    for name, grams in profiles.items():
        rank = {g: i for i, g in enumerate(grams)}
        gaps[name] = sum(abs(rank[g] - i) if g in rank else size for i, g in enumerate(top))
    best = min(sorted(gaps), key=gaps.get)
    return best, 1 - gaps[best] / (size * len(top))


def seeds_hit(text, item, masks, span):
    """Shifts at which some mask sees the same tokens in both."""
    split = lambda t: [x for x in re.split(r"[^\w]+|_+", (t or "").lower()) if x]
    a, b = split(text), split(item)
    found = set()
    for p in range(len(a) - span + 1):
        for q in range(len(b) - span + 1):
            if any(all(a[p + k] == b[q + k] for k in range(span) if m[k] == "1") for m in masks):
                found.add(p - q)
    return found, a, b


def cosine(text, template, idf, unknown):
    split = lambda t: Counter(re.findall(r"[^\W_]+", t.lower()))
    a, b = split(text), split(template)
    weight = lambda c: {t: n * idf.get(t, unknown) for t, n in c.items()}
    x, y = weight(a), weight(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(t, 0) for t, v in x.items()) / norm if norm else 0.0
