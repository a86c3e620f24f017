"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Texts become hashed counts of words and of word shapes, weighted by TF-IDF; a truncated SVD of a
bounded labelled sample gives the latent space.  The sample's vectors are broadcast (their number is
a parameter); every document's cosine products with all of them are computed in blocks, and the
labels of its nearest neighbours are averaged with their similarities as weights.

Defined cases: a null or empty text has no direction and gets the sample's share of label 1; without
labelled rows every score is 0.5; labels null or for unknown documents are ignored; repeated rows get equal scores; very long
texts are counted whole; an empty table gives an empty result; other input columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import remainder, sample
from .shared import groups_of_text, small_batches, table
from .words import Words

#: Hashed dimensions for words and for shapes, latent dimensions, neighbours.
WORDS, SHAPES, LATENT, NEAREST = 1024, 512, 64, 15
SHAPE_WEIGHT = 3.0


def shape(kind: str, tail: str, size: int) -> int:
    """Dimension of a word's shape: its kind, its closing signs, its length in steps of four."""
    import zlib

    return WORDS + zlib.crc32(f"{kind} {tail} {size}".encode()) % (SHAPES - 1)


def places(word: bytes) -> tuple[int, int]:
    """Hashed dimensions of a word's letters and of its shape."""
    import zlib

    core = word if word.isalpha() else word[:-1]
    if core.isalpha() and (core is word or word[-1] in b".,;:?)"):  # letters alone, or with one other sign: no tail
        kind = "U" if len(core) > 1 and core.isupper() else "C" if core[:1].isupper() else "l" if core.islower() else "m"
        return zlib.crc32(core.lower()) % WORDS, shape(kind, "", min(len(core) // 4, 4))
    s = word.decode("utf-8", "replace")
    core = s if s.isalnum() else s.strip("".join(c for c in s if not c.isalnum()))
    tail = s[len(s.rstrip("!#$%&*|<>")) :]
    kind = "n" if core.isnumeric() else "U" if len(core) > 1 and core.isupper() else "C" if core[:1].isupper() else "l" if core.islower() else "m"
    return zlib.crc32(core.lower().encode()) % WORDS, shape(kind if core else "-", tail[:3], min(len(core) // 4, 4))


def counted(texts, cache: dict | None = None):
    """(n, WORDS + SHAPES) counts of a list or Arrow column of texts: each word once by its letters and once by its
    shape, and each repeat of a word's predecessor.  cache: places of words met before (it is emptied when it is large)."""
    import numpy as np
    import pyarrow as pa

    w = Words(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
    width, cache = WORDS + SHAPES, {} if cache is None else cache
    out = np.zeros((len(texts), width), np.float32)
    if not len(w.hash):
        return out
    if len(cache) > 400_000:
        cache.clear()
    codes, first = w.numbered()
    unique = w.bytes(first)
    for x in unique:
        if x not in cache:
            cache[x] = places(x)
    at = np.array([cache[x] for x in unique], np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(w.first))
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    cells = np.concatenate([row * width + at[codes, 0], row * width + at[codes, 1], row[again] * width + width - 1])
    out += np.bincount(cells, minlength=out.size).reshape(out.shape)
    return out


class Space:
    """The latent space of a labelled sample, and the voting."""

    def __init__(self, counts, y):
        import numpy as np

        self.share = float(y.mean()) if len(y) else 0.5
        self.idf = (np.log((1 + len(y)) / (1 + (counts > 0).sum(axis=0))) + 0.2).astype(np.float32)
        self.idf[WORDS:] *= SHAPE_WEIGHT
        x = self.weighted(counts)
        if len(y):
            values, vectors = np.linalg.eigh(x.T @ x)
            self.basis = np.ascontiguousarray(vectors[:, ::-1][:, : min(LATENT, len(y))]).astype(np.float32)
        else:
            self.basis = np.zeros((counts.shape[1], 1), np.float32)
        self.known, self.y = self.latent(counts), np.asarray(y, np.float32)

    def weighted(self, counts):
        import numpy as np

        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def latent(self, counts):
        import numpy as np

        z = self.weighted(counts) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def votes(self, counts, block: int = 256):
        import numpy as np

        out = np.full(len(counts), self.share)
        if not len(self.y):
            return out
        z, k = self.latent(counts), min(NEAREST, len(self.y))
        for a in range(0, len(z), block):
            cosine = z[a : a + block] @ self.known.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 4 + 1e-6
            score = (weight * self.y[near]).sum(axis=1) / weight.sum(axis=1)
            out[a : a + block] = np.where(counts[a : a + block].any(axis=1), score, self.share)
        return np.clip(out, 0, 1)


def fitted(docs: DataFrame, labels: DataFrame, label: str, usable, most: int = 4000) -> Space:
    """Counts of the sample are made on the executors; most rows of fixed width reach the driver."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        for b in groups_of_text(batches, 0):
            c = counted(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in c], pa.binary()), b.column(1)], ["c", "y"])

    rows = sample(docs, labels, label, usable, most).mapInArrow(count, "c binary, y int").collect()
    rows.sort(key=lambda r: (r["c"], r["y"]))  # the order of arrival plays no part
    counts = np.array([np.frombuffer(r["c"], np.float32) for r in rows]) if rows else np.zeros((0, WORDS + SHAPES), np.float32)
    return Space(counts, np.array([r["y"] for r in rows], np.float32))


def scored(docs: DataFrame, space: Space, text: str = "text", score: str = "score") -> DataFrame:
    """Every column of docs and its score; an input column of the score's name gives way to it."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() == score.lower()])
    names = docs.columns
    at = names.index(text)
    model = docs.sparkSession.sparkContext.broadcast(vars(space))  # plain arrays: workers need no class

    def run(batches):
        import pyarrow as pa

        here = Space.__new__(Space)
        here.__dict__.update(model.value)
        cache: dict = {}
        for b in groups_of_text(batches, at, 2 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(here.votes(counted(b.column(at), cache)), pa.float64())], [*names, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    space = fitted(docs, table(spark, sf_dir, "labels"), "quality", lambda k: remainder(k, 5) != 0)
    out = scored(docs, space)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
