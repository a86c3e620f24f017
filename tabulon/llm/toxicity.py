"""Toxicity by weak supervision.

Voters are lexicons and patterns: words, and word beginnings of four and five letters, that
mark label 1 in a bounded labelled sample (each family split over several voters), a repeated-hit
voter, two voters for the other side, and the annotator of the sample.  A generative label model over a
latent label estimates, by expectation maximisation, each voter's accuracy and the correlations of voters given the
label: a tree joins the voters that share most beyond the label (Friedman, Geiger and Goldszmidt 1997), and a vote's
probability depends on the label and on the vote of its neighbour in the tree.  The model starts from the lexicon and
pattern votes alone.  Its posterior labels train a linear classifier, whose penalty is chosen by cross-validation within
the sample, and which scores every document.

Defined cases: a null or empty text shows no feature and gets the classifier's bias; without labelled
rows of both kinds every score is 1 / (1 + e^30), about 1e-13; labels that are null are ignored, and of several labels
of an id the largest counts; repeated rows get equal scores; whole texts
are read however long; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, sample
from .shared import groups_of_text, small_batches, stored, table

#: Features kept for voters and classifier; voters per family.
FEATURES, SPLIT = 3000, 4
#: Accuracy that the annotator is taken to have, before the votes are seen.
TRUST = 0.99
PUNCTUATION = b"".join(bytes((c,)) for c in range(33, 127) if not chr(c).isalnum())


def features_of(word: bytes) -> tuple[bytes, ...]:
    """Tagged features of one word: itself in lower case without outer punctuation, and its beginnings."""
    w = word.strip(PUNCTUATION).decode("utf-8", "replace").lower()
    if len(w) < 3:
        return ()
    out = ["w" + w]
    for n in (4, 5):
        if len(w) > n:
            out.append(f"{n}" + w[:n])
    return tuple(x.encode() for x in out)


def present(text: str | None, cache: dict) -> set:
    """The features of a text; cache holds those of words already met."""
    out: set = set()
    for w in set((text or "").encode("utf-8", "replace").split()):
        got = cache.get(w)
        if got is None:
            got = cache[w] = features_of(w)
        out.update(got)
    return out


def tree_of(joint) -> list[int]:
    """Each voter's neighbour towards voter 0 in the tree of most mutual information given the label (-1 for voter 0).

    joint: (labels, voters, votes, voters, votes) weights of pairs of votes."""
    import numpy as np

    weight = joint.sum(axis=(2, 4), keepdims=True).clip(1e-9)
    p = joint / weight
    apart = p.sum(axis=4, keepdims=True) * p.sum(axis=2, keepdims=True)
    share = weight / weight.sum(axis=0, keepdims=True)
    shared = (share * p * np.log((p + 1e-12) / (apart + 1e-12))).sum(axis=(0, 2, 4))
    parent, best, near = [-1] * len(shared), shared[0].copy(), [0] * len(shared)
    left = set(range(1, len(shared)))
    while left:  # Prim's algorithm
        v = max(left, key=lambda k: (best[k], -k))
        left.remove(v)
        parent[v] = near[v]
        for k in left:
            if shared[v, k] > best[k]:
                best[k], near[k] = shared[v, k], v
    return parent


def label_model(votes, start, trusted: dict[int, float] | None = None, rounds: int = 40):
    """Posterior of label 1 for each row of votes (1, 0 for no vote, -1), starting from start; P(vote | label) of each
    voter as (label, vote, voter); and the tree.  trusted: voters whose accuracy is known beforehand to be about so
    much, which counts twice as much as the rows; they stand apart from the tree.

    The tree is drawn from the start's labels, so that many voters of one mind do not pass for many, and anew every five
    rounds."""
    import numpy as np

    n, v = votes.shape
    index = votes.astype(int) + 1
    kinds = np.zeros((n, v, 3))
    np.put_along_axis(kinds, index[:, :, None], 1, axis=2)
    flat = kinds.reshape(n, 3 * v)
    post, parent, known = start.astype(np.float64).clip(0.02, 0.98), [], trusted or {}
    for k in range(rounds):
        share = post.mean().clip(1e-3, 1 - 1e-3)
        joint = np.stack([(flat.T * q) @ flat for q in (1 - post, post)]).reshape(2, v, 3, v, 3)
        if k % 5 == 0:
            parent = tree_of(joint)
            parent = [-1 if x in known or parent[x] in known else parent[x] for x in range(v)]
        like = np.stack([np.einsum("n,nvk->kv", q, kinds) + 0.1 for q in (1 - post, post)])
        for x, right in known.items():
            for label, q in ((0, 1 - post), (1, post)):
                like[label, :, x] += 2 * q.sum() * np.array((right, 0, 1 - right) if label == 0 else (1 - right, 0, right))
        like /= like.sum(axis=1, keepdims=True)
        total = np.full(n, np.log(share / (1 - share)))
        for x in range(v):
            if parent[x] < 0:
                odds = np.log(like[1, :, x]) - np.log(like[0, :, x])
                total += odds[index[:, x]]
            else:  # tables given the neighbour's vote, drawn towards the voter's own
                pair = joint[:, x, :, parent[x], :]
                table = (pair + 2 * like[:, :, x][:, :, None]) / (pair.sum(axis=1, keepdims=True) + 2)
                odds = np.log(table[1]) - np.log(table[0])
                total += odds[index[:, x], index[:, parent[x]]]
        post = 1 / (1 + np.exp(-total.clip(-30, 30)))
    return post, like, parent


@dataclass
class Classifier:
    """Weights of features present in a text; one bias."""

    weight: dict[bytes, float]
    bias: float


def scores(weight: dict[bytes, float], bias: float, texts: list, cache: dict):
    """Scores of texts; cache holds the weighted features of words already met."""
    import numpy as np

    out = np.empty(len(texts))
    for k, t in enumerate(texts):
        found: dict = {}
        for w in set((t or "").encode("utf-8", "replace").split()):
            got = cache.get(w)
            if got is None:
                got = cache[w] = tuple((f, weight[f]) for f in features_of(w) if f in weight)
            if got:
                found.update(got)
        out[k] = bias + sum(x for _, x in sorted(found.items()))
    if len(cache) > 500_000:
        cache.clear()
    return 1 / (1 + np.exp(-out.clip(-30, 30)))


def logistic(x, y, weights, penalty: float = 0.001, rounds: int = 300):
    """Weights and bias of a logistic regression on soft labels with an L1 penalty, by accelerated proximal steps.

    The penalty leaves weight on what marks many texts and none on words that merely stand in copies of a few."""
    import numpy as np

    x, weights = x.astype(np.float32), (weights / weights.sum()).astype(np.float32)
    w, b, before, bias_before, t = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0, 1.0
    v = np.random.default_rng(1).standard_normal(x.shape[1]).astype(np.float32)
    for _ in range(20):  # the largest curvature sets the step
        v /= np.linalg.norm(v) + 1e-12
        v = x.T @ (weights * (x @ v))
    step = 1 / (0.25 * (np.linalg.norm(v) + 1) + 1e-6)
    for _ in range(rounds):
        t, ahead = (1 + (1 + 4 * t * t) ** 0.5) / 2, (t - 1) / ((1 + (1 + 4 * t * t) ** 0.5) / 2)
        u, c = w + ahead * (w - before), b + ahead * (b - bias_before)
        e = weights * (1 / (1 + np.exp(-(x @ u + c).clip(-30, 30))) - y)
        before, bias_before = w, b
        w = u - step * (x.T @ e)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b = c - step * float(e.sum())
    return w, b


def validated(x, y, weights, penalties=(0.0003, 0.001, 0.003), folds: int = 3) -> float:
    """Of the penalties, the one of least loss on rows left out of the fit (ties: the largest)."""
    import numpy as np

    fold = np.arange(len(y)) % folds  # rows come in the order of their bits, so folds are alike
    loss = []
    for c in penalties:
        total = 0.0
        for k in range(folds):
            here = fold != k
            w, b = logistic(x[here], y[here], weights[here], c, 80)
            z = (x[~here] @ w + b).clip(-30, 30)
            total += float((weights[~here] * (np.logaddexp(0, z) - y[~here] * z)).sum())
        loss.append(total)
    return max(c for c, t in zip(penalties, loss) if t <= min(loss) * 1.001)


def fitted(docs: DataFrame, labels: DataFrame, label: str, usable, most: int = 6000) -> Classifier:
    """Feature counts are grouped on the executors; the driver gets FEATURES of them and most rows of bits."""
    import zlib

    import numpy as np

    rows = stored(sample(docs, labels, label, usable, most))
    small_batches(docs.sparkSession)

    def count(batches):
        import pyarrow as pa

        cache: dict = {}
        for b in groups_of_text(batches, 0):
            pos: dict = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in present(t, cache):
                    c = pos.setdefault(f, [0, 0])
                    c[y] += 1
            cache.clear()
            yield pa.RecordBatch.from_arrays([pa.array([*pos], pa.binary()), pa.array([c[1] for c in pos.values()], pa.int64()), pa.array([c[0] for c in pos.values()], pa.int64())], ["f", "p", "n"])

    of = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = of.get(1, 0), of.get(0, 0)
    if not n1 or not n0:
        return Classifier({}, -30.0)
    counts = rows.mapInArrow(count, "f binary, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("p + n >= 2")
    ratio = F.log(((F.col("p") + 0.5) / (n1 + 1)) / ((F.col("n") + 0.5) / (n0 + 1)))
    # Features seen in too few labelled texts of a kind are chance; the least support grows with the sample.
    support = F.col("p") >= max(3, n1 / 100)
    kept = counts.withColumn("r", ratio).where((F.col("r") > 3) & support | (F.col("r") < -0.7) & (F.col("n") >= n0 / 20))
    top = kept.orderBy(F.desc(F.greatest(F.col("r"), F.lit(0)) * F.sqrt(F.col("p"))), F.desc(F.abs("r") * F.sqrt(F.col("n"))), "f").limit(FEATURES).collect()
    names, strong = [bytes(r["f"]) for r in top], [r["r"] for r in top]
    hits = [r["p"] for r in top]
    index = {f: k for k, f in enumerate(names)}

    def bits(batches):
        import pyarrow as pa

        cache: dict = {}
        for b in groups_of_text(batches, 0):
            out = []
            for t in b.column(0).to_pylist():
                x = np.zeros(len(index), bool)
                x[[index[f] for f in present(t, cache) if f in index]] = True
                out.append(np.packbits(x).tobytes())
            cache.clear()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column(1)], ["x", "y"])

    got = sorted((bytes(r["x"]), r["y"]) for r in rows.mapInArrow(bits, "x binary, y int").collect())
    if not names:
        return Classifier({}, -30.0)
    x = np.array([np.unpackbits(np.frombuffer(r[0], np.uint8), count=len(names)) for r in got], np.uint8)
    y = np.array([r[1] for r in got])
    family = np.array([{"w": 0, "4": 1, "5": 2}[f[:1].decode()] for f in names])
    marks = np.array([r > 3.0 and p >= max(3, n1 / 100) for r, p in zip(strong, hits)])
    part = np.array([zlib.crc32(f) % SPLIT for f in names])
    votes = []
    for fam in range(3):
        for p in range(SPLIT):
            votes.append((x[:, marks & (family == fam) & (part == p)].any(axis=1)).astype(np.int8))
    lexical = x[:, marks & (family == 0)].sum(axis=1)
    pattern = x[:, marks & (family > 0)].sum(axis=1)
    votes += [(lexical + pattern >= 3).astype(np.int8), -((lexical == 0) & (pattern == 0)).astype(np.int8), -((lexical == 0) & (pattern <= 1)).astype(np.int8)]
    start = np.where((np.stack(votes, axis=1) > 0).sum(axis=1) >= 3, 0.8, 0.1)  # where lexicons and patterns agree
    votes.append((2 * y - 1).astype(np.int8))  # the annotator is one more voter, taken to be right nearly always
    post, _, _ = label_model(np.stack(votes, axis=1).astype(np.float64), start, {len(votes) - 1: TRUST})
    balance = np.where(post > 0.5, len(y) / (2 * max(1.0, post.sum())), len(y) / (2 * max(1.0, (1 - post).sum())))
    w, b = logistic(x, post, balance, validated(x, post, balance))
    return Classifier({names[k]: float(w[k]) for k in range(len(names)) if w[k]}, float(b))


def scored(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))  # plain values: workers need no class

    def run(batches):
        import pyarrow as pa

        cache: dict = {}
        for b in groups_of_text(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(*shared.value, b.column(1).to_pylist(), cache), pa.float64())], ["doc_id", "score"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"), "toxic", lambda k: remainder(k, 3) != 1)
    return scored(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
