"""Packing along a space-filling curve.

Each document's token ids give a hashed vector, which a fixed random projection takes to four
dimensions; its Hilbert index (and a hash of the document's id, which spreads copies) is its place on
the curve.  Documents are range-sorted by that key, laid end to end, and the line is cut every 4096
tokens, so that neighbours share sequences and only the last sequence can be short.

The range boundaries are quantiles of the keys.  Only the token total of each range (a number set by
the partition count) reaches the driver; it gives every range its start on the line, so each range is
cut without the others.

Defined cases: a null or empty text is one end token; equal keys are ordered by doc_id (nulls first)
and length; repeated rows are packed each; a very long text spans many sequences; an empty table gives an empty
result; only the key and text columns are read, so other columns' names cannot clash.
"""
from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import groups_of_text, partitions, small_batches, stored, table, worker_state
from .words import Words, laid_out

DIMENSIONS, BITS, HASHED = 4, 10, 256


class WordIds:
    """Ids of texts through a tokenizer whose words stand alone; words already met are looked up.

    Texts are cut at ASCII white space and ASCII letters lowered first, which this tokenizer does
    itself; a word's trailing punctuation is taken apart where a letter stands before it.  Words of letters alone are
    encoded many to a call and told apart by the ids that end a word."""

    PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())

    def __init__(self, path: str, most: int = 96 << 20):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most, self.seen, self.size = most, {}, 0  # most: bytes of words and ids to remember
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True

    def learn(self, words: set[bytes]) -> None:
        import numpy as np

        signs = frozenset(self.PUNCTUATION)
        whole, parts = {w for w in words if w[-1] not in signs}, []
        for w in words - whole:
            core = w.rstrip(self.PUNCTUATION)
            if core and core.decode("utf-8", "replace")[-1].isalpha():
                tail = w[len(core) :]
                parts.append((w, core, tail))
                whole.add(core)
                whole.add(tail)
            else:
                whole.add(w)
        new = list(whole.difference(self.seen))
        letters, others = [], []
        for w in new:
            (letters if w.isalpha() or w.decode("utf-8", "replace").isalpha() else others).append(w)
        lines = [letters[i : i + 250] for i in range(0, len(letters), 250)] + [[w] for w in others]
        for i in range(0, len(lines), 200):
            some = lines[i : i + 200]
            for line, e in zip(some, self.tokenizer.encode_batch_fast([b" ".join(x).decode("utf-8", "replace") for x in some], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint16)
                cuts = (2 * (np.nonzero(self.ends[ids])[0] + 1)).tolist()
                if len(line) == 1:
                    self.seen[line[0]] = ids.tobytes()
                elif len(cuts) == len(line):  # a word of letters has one end at least, so each has exactly one
                    joined = ids.tobytes()
                    self.seen.update(zip(line, map(joined.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))
                else:
                    for w, alone in zip(line, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in line], add_special_tokens=False)):
                        self.seen[w] = np.array(alone.ids, np.uint16).tobytes()
        for w, core, tail in parts:
            self.seen[w] = self.seen[core] + self.seen[tail]
        self.size += 160 * (len(new) + len(parts)) + 3 * sum(map(len, words))  # ids take two bytes for one of the word at most

    def encode(self, column) -> list[bytes]:
        """The ids of each text of an Arrow column as 16-bit numbers (the vocabulary has fewer than 65,536)."""
        if self.size > self.most:
            self.seen.clear()
            self.size = 0
        w = Words(column, lower=True)
        codes, first = w.numbered()
        distinct = w.bytes(first)
        new = set(distinct).difference(self.seen)
        if new:
            self.learn(new)
        return list(laid_out([self.seen[x] for x in distinct], codes, w.first, 2))


def hilbert(points):
    """Hilbert indices of an (n, d) array of BITS-bit coordinates, by Gray-code undoing level by level (Skilling 2004)."""
    import numpy as np

    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (BITS - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (BITS - 1)
    while q > 1:
        turn ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_places(ids: list, weights):
    """Hilbert index of each array of token ids: hashed counts, unit length, projected, squashed to a grid."""
    import numpy as np

    v = np.zeros((len(ids), HASHED), np.float32)
    for k, a in enumerate(ids):
        v[k] = np.bincount((a.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=HASHED)
    v = np.sqrt(v)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    at = 0.5 + 0.5 * np.tanh(2.0 * (v @ weights))
    return hilbert(np.minimum((at * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenized(docs: DataFrame, vocabulary: str, end: int, key: str, text: str) -> DataFrame:
    """(doc_id, place, n, ids): place is the Hilbert index over 23 bits of a hash of the row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        words = worker_state(f"ids {vocabulary}", lambda: WordIds(vocabulary))
        random = np.random.default_rng(20240229).standard_normal((HASHED, DIMENSIONS)).astype(np.float32)
        weights = random - random.mean(axis=0)
        last = np.array([end], np.uint16).tobytes()
        for b in groups_of_text(batches, 1):
            ids = [x + last for x in words.encode(b.column(1))]
            place = curve_places([np.frombuffer(x, np.uint16) for x in ids], weights)
            spread = np.array([zlib.crc32(str(k).encode()) >> 9 for k in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((place << 23) | spread), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "place", "n", "ids"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, place long, n long, ids binary")


def packed(docs: DataFrame, vocabulary: str, end: int = 2, length: int = 4096, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = stored(tokenized(docs, vocabulary, end, key, text))
    ranges = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    rows = ranged(rows, sorted(set(cuts)))
    totals = {r["range"]: r["n"] for r in rows.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # as many rows as ranges
    starts, at = {}, 0
    for r in sorted(totals):
        starts[r], at = at, at + totals[r]
    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids

    def cut(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        here, at = None, 0
        for b in batches:
            docs_, out = b.column("doc_id"), [[] for _ in range(8)]
            for k, (r, ids) in enumerate(zip(b.column("range").to_pylist(), b.column("ids").to_pylist())):
                if r != here:
                    here, at = r, starts[r]
                wide, n, start = np.frombuffer(ids, np.uint16).astype("<u4").tobytes(), len(ids) // 2, 0
                while start < n:
                    size = min(n - start, length - at % length)
                    piece = wide[4 * start : 4 * (start + size)]
                    for values, x in zip(out, (k, start, size, zlib.crc32(piece), n, at // length, at % length, piece if keep_ids else None)):
                        values.append(x)
                    start, at = start + size, at + size
            columns = [docs_.take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:7])] + [pa.array(out[7], pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids)

    # Ranges go to tasks by their measured sizes, the largest first, each to the task that has least.
    tasks = [(0, k) for k in range(partitions(spark))]
    to = [0] * ranges
    for r in sorted(totals, key=totals.get, reverse=True):
        load, k = tasks[0]
        to[r] = k
        heapq.heapreplace(tasks, (load + totals[r], k))
    dealt = rows.repartitionById(len(tasks), F.get(F.lit(to), F.col("range")))
    ordered = dealt.sortWithinPartitions("range", "place", "doc_id", "n", "ids")
    return ordered.select("doc_id", "range", "ids").mapInArrow(cut, fields)


def ranged(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """rows with range, the number of cuts up to place, found by halving: log2 of the cuts steps a row, not all of them."""
    line, steps = F.lit(cuts or [0]), max(1, len(cuts).bit_length())

    def halve(span, _):
        half = F.floor((span["low"] + span["high"]) / 2).cast("int")
        open_ = span["low"] < span["high"]
        right = open_ & (F.get(line, half) <= F.col("place"))
        return F.struct(F.when(right, half + 1).otherwise(span["low"]).alias("low"), F.when(open_ & ~right, half).otherwise(span["high"]).alias("high"))

    whole = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return rows.withColumn("range", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), whole, halve)["low"])


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
