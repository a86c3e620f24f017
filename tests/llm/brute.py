"""Plain versions of the operators, for small tables: loops over whole texts, all pairs, no shortcuts."""
import math
from collections import Counter

import numpy as np

from tabulon.llm import near_dedup, quality_neighbours


def words(text):
    return (text or "").encode().split()


def rules(text):
    """n_words, n_repeat_words and whether the base rules fail."""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    found = Counter(windows)
    again = {i + k for i, x in enumerate(windows) if found[x] > 1 for k in range(3)}
    return len(w), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def host_limit(rates, n, f):
    """Whether a host with f failures of n is rejected, given the rates of all hosts."""
    mean = sum(rates) / len(rates)
    var = sum((r - mean) ** 2 for r in rates) / len(rates)
    strength = 1000 if var <= 1e-12 else min(1000, max(1, mean * (1 - mean) / var - 1))
    return (f + mean * strength) / (n + strength) >= min(0.6, max(0.3, 3 * mean))


def kept_by_rules(rows):
    """Of (id, text, host): the ids that the base rule and the hosts' verdicts on it keep."""
    fails = [rules(t)[2] for _, t, _ in rows]
    hosts = {}
    for (_, _, h), bad in zip(rows, fails):
        if h is not None:
            hosts.setdefault(h, []).append(bad)
    rates = [sum(x) / len(x) for x in hosts.values()]
    rejected = {h for h, x in hosts.items() if host_limit(rates, len(x), sum(x))}
    return [i for (i, _, h), bad in zip(rows, fails) if not bad and h not in rejected]


def weighted_sets(texts):
    """Of each text {shingle: weight}, with idf over all texts."""
    sets = []
    for t in texts:
        w, counts = words(t), {}
        for s in [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []:
            counts[s] = counts.get(s, 0) + 1
        sets.append(counts)
    df = {}
    for s in sets:
        for x in s:
            df[x] = df.get(x, 0) + 1
    n, c, low = len(texts), near_dedup.COMMON, near_dedup.FLOOR
    idf = {x: low + (1 - low) * math.log(n / k) / math.log(1 / c) if k >= c * n else 1.0 for x, k in df.items()}
    return [{x: (1 + math.log(k)) * idf[x] for x, k in s.items()} for s in sets]


def near_classes(ids, texts, threshold=0.8):
    """{id: least id of its class}, by all pairs; ids are distinct."""
    sets, parent = weighted_sets(texts), list(range(len(texts)))
    holders: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    total, inner = np.array([sum(s.values()) for s in sets]), np.zeros((len(sets), len(sets)))
    for x, who in holders.items():
        if len(who) > 1:
            w = np.array([sets[i][x] for i in who])
            inner[np.ix_(who, who)] += np.minimum.outer(w, w)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    alike = (inner >= threshold * (total[:, None] + total - inner) - 1e-9) & (total > 0)
    for i, j in zip(*np.nonzero(np.tril(alike, -1))):
        a, b = find(int(i)), find(int(j))
        if a != b:
            parent[a if ids[a] > ids[b] else b] = b if ids[a] > ids[b] else a
    return {k: ids[find(i)] for i, k in enumerate(ids)}


def without_repeats(rows, k=13):
    """Of (id, text): (kept words, number removed) by id; ids are distinct."""
    cut = [(i, words(t)) for i, t in rows]
    least = {}
    for i, w in cut:
        for p in range(len(w) - k + 1):
            x = tuple(w[p : p + k])
            least[x] = min(i, least.get(x, i))
    out = {}
    for i, w in cut:
        gone = {p + j for p in range(len(w) - k + 1) if least[tuple(w[p : p + k])] < i for j in range(k)}
        out[i] = [x for j, x in enumerate(w) if j not in gone], len(gone)
    return out


def neighbour_scores(sample, texts):
    """Scores by exact cosines in the latent space of sample (text, label) rows, one document and neighbour at a time."""
    q = quality_neighbours
    known = q.counted([t for t, _ in sample]).astype(float)
    y = [float(v) for _, v in sample]
    idf = np.log((1 + len(y)) / (1 + (known > 0).sum(axis=0))) + 0.2
    idf[q.WORDS :] *= q.SHAPE_WEIGHT

    def unit(x):
        return x / max(np.linalg.norm(x), 1e-9)

    rows = np.array([unit(np.log1p(c) * idf) for c in known])
    basis = np.linalg.svd(rows, full_matrices=False)[2][: min(q.LATENT, len(y))].T
    spots, out = [unit(r @ basis) for r in rows], []
    for t in texts:
        c = q.counted([t])[0].astype(float)
        if not c.any():
            out.append(sum(y) / len(y))
            continue
        z = unit(unit(np.log1p(c) * idf) @ basis)
        near = sorted(((float(z @ s), v) for s, v in zip(spots, y)), key=lambda p: -p[0])[: q.NEAREST]
        weight = [max(s, 0) ** 4 + 1e-6 for s, _ in near]
        out.append(sum(a * v for a, (_, v) in zip(weight, near)) / sum(weight))
    return out
