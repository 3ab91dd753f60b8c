"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k, lower=True):
    own = words((text or "").translate(UP) if lower else text)
    if not own:
        return frozenset()
    if len(own) < k:
        return frozenset([tuple(own)])
    return frozenset(tuple(own[i : i + k]) for i in range(len(own) - k + 1))


def components(docs, k, num, den):
    """docs: (id, text) -> {position: (set size, least id reachable)}; all pairs."""
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        r = find(i)
        known = [x for x in (least.get(r), doc_id) if x is not None]
        least[r] = min(known) if known else None
    return [(len(sets[i]), least[find(i)]) for i in range(len(docs))]


def without_repeats(docs, size):
    """docs: (id, text) -> [(n_words, n_removed, kept words)]."""
    first = {}
    for doc_id, text in docs:
        own = words(text)
        for i in range(len(own) - size + 1):
            w = tuple(own[i : i + size])
            if doc_id is not None:
                first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        own, gone = words(text), set()
        for i in range(len(own) - size + 1):
            if doc_id is not None and first[tuple(own[i : i + size])] < doc_id:
                gone.update(range(i, i + size))
        out.append((len(own), len(gone), [w for i, w in enumerate(own) if i not in gone]))
    return out


def exact(docs):
    """docs: (id, text) with distinct ids -> {id: (keep, size, kept, sha)}."""
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[(text or "").translate(UP)].append(doc_id)
    out = {}
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            out[i] = (max(ids), len(ids), i == max(ids), sha)
    return out


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    own = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    triples = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    seen, covered = Counter(triples), set()
    for i, t in enumerate(triples):
        if seen[t] > 1:
            covered.update((i, i + 1, i + 2))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(covered)


def failed(text):
    n, _, _, _, repeat = counts(text)
    return n < 50 or 100 * repeat > 50 * n


class KneserNey:
    """Interpolated modified Kneser-Ney over symbol tuples, with dictionaries."""

    def __init__(self, texts, fold, order=4, alphabet=64):
        self.order, self.alphabet, self.fold = order, alphabet, fold
        top = Counter()
        for t in texts:
            top.update(self.grams(t))
        levels = {order: top}
        for k in range(order - 1, 0, -1):
            before = defaultdict(set)
            for g in levels[k + 1]:
                before[g[1:]].add(g[0])
            levels[k] = Counter({g: len(s) for g, s in before.items()})
        self.levels, self.off, self.total, self.freed = levels, {}, {}, {}
        for k, level in levels.items():
            of = [sum(c == n for c in level.values()) for n in (1, 2, 3, 4)]
            off = [0.0] * 4
            if of[0]:
                y = of[0] / (of[0] + 2 * of[1])
                for c in (1, 2, 3):
                    d = c - (c + 1) * y * of[c] / of[c - 1] if of[c - 1] else 0.0
                    off[c] = min(max(d, 0.1), c - 0.1)
            self.off[k] = off
            self.total[k], self.freed[k] = Counter(), defaultdict(float)
            for g, c in level.items():
                self.total[k][g[:-1]] += c
                self.freed[k][g[:-1]] += off[min(c, 3)]

    def grams(self, text):
        s = [0] * (self.order - 1) + [int(self.fold[b]) for b in text.encode()]
        return [tuple(s[i : i + self.order]) for i in range(len(s) - self.order + 1)]

    def p(self, g):
        if not g:
            return 1 / self.alphabet
        k, context = len(g), g[:-1]
        total = self.total[k].get(context)
        if not total:
            return self.p(g[1:])
        c = self.levels[k].get(g, 0)
        return (c - self.off[k][min(c, 3)]) / total + self.freed[k][context] / total * self.p(g[1:])

    def log_perplexity(self, text):
        known = {}
        own = self.grams(text)
        for g in set(own):
            known[g] = math.log(self.p(g))
        return -sum(known[g] for g in own) / len(own)


def bands(rows, width, least, step):
    """rows: (lang, log perplexity) of texts that pass -> {lang: (low, high)}."""
    by = defaultdict(list)
    for lang, v in rows:
        by[lang].append(math.floor(v * step + 0.5))
    out = {}
    for lang, own in by.items():
        own.sort()
        middle = own[(len(own) - 1) // 2]
        away = sorted(abs(v - middle) for v in own)[(len(own) - 1) // 2]
        half = max(away * 1.4826 / step, least) * width
        out[lang] = (middle / step - half, middle / step + half)
    return out
