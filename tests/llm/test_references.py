"""Models against plain versions: neighbour votes, label model, penalised regression, the curve."""
import itertools

import numpy as np
import pytest

from tabulon.llm import packing, quality_neighbours, toxicity

from . import brute


def prose(g, n, marks=""):
    return " ".join("".join(g.choice(list("abcdefghij"), g.integers(2, 8))) + (marks if g.random() < 0.3 else "") for _ in range(n))


def test_neighbour_votes_match_exact_ones():
    g = np.random.default_rng(3)
    sample = [(prose(g, 40, "" if k % 3 else "!!"), k % 3 > 0) for k in range(90)]
    texts = [prose(g, 30, "!!" if k % 2 else "") for k in range(40)] + ["", None, sample[0][0], "x"]
    counts = quality_neighbours.counted([t for t, _ in sample])
    space = quality_neighbours.Space(counts, np.array([y for _, y in sample], np.float32))
    got = space.votes(quality_neighbours.counted(texts), block=7)
    assert np.abs(got - brute.neighbour_scores(sample, texts)).max() < 2e-3


def test_label_model_finds_accuracies_and_counts_copies_once():
    g = np.random.default_rng(5)
    n = 4000
    truth = g.random(n) < 0.3

    def voter(right):
        return np.where(g.random(n) < right, truth, ~truth) * 2 - 1

    one, two, three, four = voter(0.85), voter(0.8), voter(0.75), voter(0.85)
    copies = [np.where(g.random(n) < 0.97, one, -one) for _ in range(4)]  # say what the first says
    votes = np.stack([one, *copies, two, three, four], axis=1).astype(float)
    start = np.where(votes[:, [0, 5, 6, 7]].sum(axis=1) > 0, 0.8, 0.2)
    post, like, tree = toxicity.label_model(votes, start)
    alone, _, _ = toxicity.label_model(votes[:, [0, 5, 6, 7]], start)
    assert ((post > 0.5) == truth).mean() > ((alone > 0.5) == truth).mean() - 0.02  # five votes of one mind do not outvote the rest
    family = set(range(5))
    assert sum(p in family for v, p in enumerate(tree) if v in family and p >= 0) >= 3
    assert all(abs(like[1, 2, v] - want) < 0.08 for v, want in ((5, 0.8), (6, 0.75), (7, 0.85)))


def test_tree_is_the_best_of_all_trees():
    g = np.random.default_rng(8)
    joint = g.random((2, 4, 3, 4, 3))
    joint = joint + joint.transpose(0, 3, 4, 1, 2)

    def worth(v, u):
        total = 0.0
        weight = [joint[y, v, :, u, :].sum() for y in range(2)]
        for y in range(2):
            p = joint[y, v, :, u, :] / weight[y]
            total += weight[y] / sum(weight) * sum(p[a, b] * np.log(p[a, b] / (p[a].sum() * p[:, b].sum())) for a in range(3) for b in range(3))
        return total

    def connected(edges):
        seen = {0}
        for _ in range(4):
            seen |= {b for a, b in edges if a in seen} | {a for a, b in edges if b in seen}
        return len(seen) == 4

    best = max(sum(worth(a, b) for a, b in e) for e in itertools.combinations(itertools.combinations(range(4), 2), 3) if connected(e))
    tree = toxicity.tree_of(joint)
    assert sum(worth(v, p) for v, p in enumerate(tree) if p >= 0) == pytest.approx(best)


def test_penalised_regression_reaches_the_optimum():
    g = np.random.default_rng(2)
    x = (g.random((300, 12)) < 0.3).astype(np.uint8)
    y = 1 / (1 + np.exp(-(2.0 * x[:, 0] - 1.5 * x[:, 1] - 0.3)))
    weight = np.where(y > 0.5, 2.0, 1.0)

    def loss(w, b, c):
        z = x @ w + b
        return float((weight / weight.sum() * (np.logaddexp(0, z) - y * z)).sum() + c * np.abs(w).sum())

    for c in (0.001, 0.01):
        w, b = toxicity.logistic(x, y, weight, c, 400)
        slow_w, slow_b = np.zeros(12), 0.0
        for _ in range(20000):  # plain proximal steps
            e = weight / weight.sum() * (1 / (1 + np.exp(-(x @ slow_w + slow_b))) - y)
            slow_w = slow_w - 0.5 * (x.T @ e)
            slow_w = np.sign(slow_w) * np.maximum(np.abs(slow_w) - 0.5 * c, 0)
            slow_b -= 0.5 * e.sum()
        assert loss(w, b, c) <= loss(slow_w, slow_b, c) + 1e-5
    rows = np.repeat(x, 2, axis=0)
    assert toxicity.validated(rows, np.repeat(y, 2), np.repeat(weight, 2)) in (0.0003, 0.001, 0.003)


def test_curve_visits_neighbours(monkeypatch):
    for bits, d in ((1, 4), (2, 4), (3, 3), (4, 2)):
        monkeypatch.setattr(packing, "BITS", bits)
        points = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        at = packing.hilbert(points)
        assert sorted(at.tolist()) == list(range(len(points)))
        line = points[np.argsort(at)]
        assert (np.abs(np.diff(line, axis=0)).sum(axis=1) == 1).all()
