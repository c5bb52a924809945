"""Plain Python forms of what the operators compute."""

import hashlib
import math
import re
from collections import Counter

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spaced(text):
    return SPACED.findall((text or "").translate(ASCII_LOWER))


def shingles(text):
    w = spaced(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def sketch_of(shingle_set):
    h = sorted({hashlib.md5(" ".join(s).encode()).hexdigest()[:16] for s in shingle_set})
    low = [x for x in h if x < "2"]
    return low if len(low) >= 16 else h[:16]


def sketch(text):
    return sketch_of(shingles(text))


def likeness(a, b):
    """Of the sketches of two shingle sets, below where both are complete."""
    x, y = sketch_of(a), sketch_of(b)
    limit = min("~" if len(s) < 16 else max("2", s[-1]) for s in (x, y))
    union = {h for h in x + y if h <= limit}
    return len([h for h in union if h in x and h in y]) / len(union) if union else 1.0


def components(sets, percent=75):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def contamination(text, items, window=10):
    """(words, hit words, item ids) of a text; `items` are (id, text) pairs."""
    w, hit, found = WORDS.findall((text or "").translate(ASCII_LOWER)), set(), set()
    for k, t in items:
        own = WORDS.findall((t or "").translate(ASCII_LOWER))
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(k))
    return len(w), len(hit), sorted(found)


def base_scores(texts, training):
    """{id: (tokens, known, log10 probability)} and N."""
    tokens = {i: [*spaced(t), "\0end"] for i, t in texts.items()}
    count = Counter(w for i in training for w in tokens[i])
    n, v = sum(count.values()), len(count)
    return {i: (len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w in tokens.items()}, n


def class_scores(texts, training, m):
    """{id: log10 probability} by the classes of a model, with all counts made anew."""
    import numpy as np

    from gridloom.llm import columns as C

    def token(w):
        raw = w.encode()
        h = 1 if w == "\0end" else C.hash_of(raw)
        i = int(np.searchsorted(m.words, np.uint64(h)))
        return i if i < len(m.words) and int(m.words[i]) == h else len(m.words) + C.hash_of(raw[-3:]) % m.endings

    tokens = {i: [*spaced(t), "\0end"] for i, t in texts.items()}
    end = token("\0end")
    of = [int(c) for c in m.symbol_class]
    count, symbols, pairs, before = Counter(), Counter(), Counter(), Counter()
    for i in training:
        last = end
        for w in tokens[i]:
            s = token(w)
            count[w] += 1
            symbols[s] += 1
            pairs[of[last], of[s]] += 1
            before[of[last]] += 1
            last = s
    rest = [w for w in count if token(w) >= len(m.words)]
    of_ending, kinds = Counter(), Counter(token(w) for w in rest)
    for w in rest:
        of_ending[token(w)] += count[w]
    in_class, classes = Counter(), len(m.log_transition)
    for s, c in enumerate(of):
        in_class[c] += symbols[s] + 0.5
    out = {}
    for i, words in tokens.items():
        total, last = 0.0, end
        for w in words:
            s = token(w)
            total += math.log10((pairs[of[last], of[s]] + 0.5) / (before[of[last]] + 0.5 * classes)) + math.log10((symbols[s] + 0.5) / in_class[of[s]])
            if s >= len(m.words):
                total += math.log10((count[w] + 0.5) / (of_ending[s] + 0.5 * (kinds[s] + 1)))
            last = s
        out[i] = total
    return out
