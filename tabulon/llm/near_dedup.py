"""Near-duplicate classes: improved consistent weighted sampling (Ioffe 2010) over TF-IDF shingles.

A document is the weighted set of its five-word shingles: weight (1 + ln tf) * idf, df and idf of every shingle.
smooth_idf is 1 + ln((1 + n) / (1 + df)) divided by that of df 1 (a common factor changes no similarity), what the query
and the pipeline use.  damped_idf, the operator's first form and still its default, leaves 1 below COMMON and falls to
FLOOR for a shingle in all documents.

Document frequencies are exact counts over all documents, the same in any layout, and no shingle is left out: documents
are frozen in blocks; a block sends its distinct shingles by hash to buckets, a bucket adds up all blocks' counts
and sends each block the frequencies of its own.  A document keeps those of its shingles beside its text.

SAMPLES consistent weighted samples a document are banded; documents that share a band are candidates, and a
candidate pair is linked if the weighted Jaccard similarity of the whole texts is at least the threshold.

Exact copies are one node.  In a band's bucket every document is first compared with the least one;
buckets that still hold several classes are compared with a second document, then all their pairs of
different classes whose samples agree by HOPE, within tasks that hold a pair of blocks of the bucket.
Large buckets of true copies cost a comparison each, and no member is dropped.  Classes are connected components of the links.

Defined cases: a null text, or one without words, is a class of its own; one to four words are one
shingle; rows that share a doc_id count as one document, whatever their texts (its class joins the classes of all of
them); rows without id (null) get class null; repeated rows fall in one class; an empty table gives an empty
result; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bucketed, fresh, groups_of_text, partitions, small_batches, stored, table, temporaries
from .substring_dedup import arrays_of, numbers
from .words import MIX, Words, mixed

SPAN, THRESHOLD = 5, 0.8
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
COMMON, FLOOR = 0.05, 0.9
#: A pair whose samples agree by less than this much is not alike: 0.8 is over four standard deviations above.
HOPE = 0.56
#: Bits of a shingle's hash; the rest hold its row in a block.
BITS = 54
#: Bytes of text to sample at once, and in a block.
AT_ONCE, BLOCK_BYTES = 1 << 20, 4 << 20
#: Shingles of one weight in a block from which the sampler tabulates the weight.
TABULATED = 128


def shingled(column):
    """Of a block of texts (1,024 at most): row, shingle hash and count of each distinct shingle, ordered by row and hash; 128-bit hash of each text's words or None."""
    import numpy as np
    import xxhash

    w = Words(column)
    count = np.diff(w.first)
    raw, at = w.hash.tobytes(), (8 * w.first).tolist()
    whole = [xxhash.xxh3_128_digest(raw[i:j]) if j > i else None for i, j in zip(at, at[1:])]
    row = np.repeat(np.arange(len(count)), count)
    x = w.runs(SPAN)
    inside = np.flatnonzero(row[: len(x)] == row[SPAN - 1 :]) if len(x) else np.zeros(0, np.int64)
    row, x = row[inside], x[inside]
    short = np.flatnonzero((count > 0) & (count < SPAN))
    if len(short):
        y = count[short].astype(np.uint64)
        for j in range(SPAN - 1):
            on = count[short] > j
            y[on] = mixed((y[on] + w.hash[w.first[short[on]] + j]) * np.uint64(MIX[j]))
        row, x = np.append(row, short), np.append(x, y)
    key = np.sort((row.astype(np.uint64) << np.uint64(BITS)) | (x >> np.uint64(64 - BITS)))
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(heads, len(key)))
    key = key[heads]
    return (key >> np.uint64(BITS)).astype(np.int64), key & np.uint64((1 << BITS) - 1), tf, whole


def smooth_idf(total: int, df):
    """Smooth inverse document frequencies in units of that of a shingle of one document."""
    import numpy as np

    return (1 + np.log((1 + total) / (1 + df))) / (1 + np.log((1 + total) / 2))


def damped_idf(total: int, df):
    """1 for shingles of fewer than COMMON of all documents; falls with the logarithm to FLOOR for one in all."""
    import numpy as np

    return np.where(df >= COMMON * total, FLOOR + (1 - FLOOR) * np.log(total / df) / np.log(1 / COMMON), 1.0)


def weighed(idf, tf, df):
    """Weights of shingles; idf: the total number of documents and the function."""
    import numpy as np

    return (1 + np.log(tf)) * idf[1](idf[0], df)


def frequencies(column):
    """The document frequencies that the rows of a binary column hold, one after the other."""
    import numpy as np

    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), "<i4")


class Sampler:
    """Consistent weighted samples; the Gamma and uniform variates of a shingle come from a table by its hash."""

    SCALE, SHIFT, BITS = float(1 << 27), 24.0, 12

    def __init__(self):
        import numpy as np

        g, n = np.random.default_rng(97), 1 << self.BITS
        self.r, self.beta, self.log_c = g.gamma(2, 1, n), g.random(n), np.log(g.gamma(2, 1, n))
        self.unit = self.place(self.r * (self.beta - 1) + self.log_c)
        self.turn = g.integers(1 << 62, size=SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def place(self, log_a):
        import numpy as np

        return np.clip(np.round((self.SHIFT + log_a) * self.SCALE), 0, (1 << 32) - 1).astype(np.uint64) << np.uint64(32)

    def samples(self, x, weight, heads):
        """(len(heads), SAMPLES) 32-bit samples of the groups of x that begin at heads."""
        import numpy as np

        out = np.empty((len(heads), SAMPLES), np.uint32)
        odd = np.flatnonzero(np.abs(weight - 1) > 1e-12)
        values, which, often = np.unique(weight[odd], return_inverse=True, return_counts=True)
        log_s, listed = np.log(values), often >= TABULATED
        # What a frequent weight makes of each place of the table, once; a rare weight's shingles are done one by one.
        tables = [self.turned(x, slice(None)) for x in log_s[listed]]
        keys, turns = (np.concatenate([t[i] for t in tables]) if tables else np.zeros(0, np.uint64) for i in (0, 1))
        row = np.cumsum(listed) - 1
        by_table = listed[which]
        many, few = odd[by_table], odd[~by_table]
        base, log_few = row[which[by_table]] << self.BITS, log_s[which[~by_table]]
        name, at, key = np.empty_like(x), np.empty_like(x), np.empty_like(x)
        down, half = np.uint64(32 - self.BITS), np.uint64(32)
        for k in range(SAMPLES):
            np.multiply(x, self.turn[k], out=name)
            np.right_shift(name, half, out=name)
            np.right_shift(name, down, out=at)
            np.take(self.unit, at.view(np.int64), out=key, mode="clip")
            np.bitwise_or(key, name, out=key)
            if len(many):
                i = base + at[many].view(np.int64)
                key[many] = keys[i] | (name[many] ^ turns[i])
            if len(few):
                place, turn = self.turned(log_few, at[few].astype(np.int64))
                key[few] = place | (name[few] ^ turn)
            out[:, k] = (np.minimum.reduceat(key, heads) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return out

    def turned(self, log_s, i):
        """Of weights by their logarithm and places i of the table: the place, and what a sample's name is combined with."""
        import numpy as np

        t = np.floor(log_s / self.r[i] + self.beta[i])
        return self.place(self.log_c[i] - self.r[i] * (t - self.beta[i]) - self.r[i]), (t.astype(np.int64) * 0x85EBCA6B).astype(np.uint64) & np.uint64(0xFFFFFFFF)


def sampled(docs: DataFrame, idf, key: str, text: str) -> DataFrame:
    """(doc, text, copy, sig, df), stored: copy is the hash of all words, sig SAMPLES 32-bit numbers, both null without
    words; df the document frequencies (32 bits each) of the document's distinct shingles in the order of their hashes."""
    kind, buckets = docs.schema[key].dataType.simpleString(), partitions(docs.sparkSession)

    def freeze(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        press = zstandard.ZstdCompressor(3)

        def block():
            nonlocal n, held, size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as w:
                for b in held:
                    w.write_batch(b)
            n, held, size = n + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), pa.array([press.compress(sink.getvalue())], pa.binary())], ["block", "data"])

        for b in groups_of_text(batches, 1, AT_ONCE):
            held.append(b)
            size += b.nbytes
            if size >= BLOCK_BYTES:
                yield block()
        if held:
            yield block()

    def opened(data: bytes):
        """A block's slices, as they were held."""
        import pyarrow as pa
        import zstandard

        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all().to_batches()

    def stretches(x):
        """(bucket, from, to) of sorted hashes."""
        import numpy as np

        bucket = ((x >> np.uint64(BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(x) else np.zeros(0, np.int64)
        return zip(bucket[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(x)).tolist())

    def ask(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, n = np.unique(np.concatenate([shingled(s.column(1))[1] for s in opened(data)]), return_counts=True)
                sent = [(g, numbers(x[i:j].astype(np.int64), n[i:j])) for g, i, j in stretches(x)]
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in sent], pa.int32()), pa.array([number] * len(sent), pa.int64()), pa.array([d for _, d in sent], pa.binary())], ["bucket", "block", "data"])

    def answer(batches):
        """The frequencies over all blocks of each block's shingles of a bucket; none if all are 1."""
        import numpy as np
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(3)

        def settle(bucket, held):
            parts = [arrays_of(data, 2) for _, data in held]
            cuts = np.cumsum([len(x) for x, _ in parts])[:-1]
            x, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            del parts
            order = np.argsort(x)
            heads = np.flatnonzero(np.append(True, x[order][1:] != x[order][:-1]))
            df = np.empty(len(x), "<i4")
            df[order] = np.repeat(np.add.reduceat(n[order], heads), np.diff(np.append(heads, len(x))))
            out = [(block, press.compress(mine.view(np.uint8).reshape(-1, 4).T.tobytes())) for (block, _), mine in zip(held, np.split(df, cuts)) if (mine > 1).any()]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array([d for _, d in out], pa.binary())], ["block", "bucket", "data"])

        here, held = None, []
        for b in batches:
            for bucket, block, data in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != here:
                    if held:
                        yield settle(here, held)
                    here, held = bucket, []
                held.append((block, data))
        if held:
            yield settle(here, held)

    def sign(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        sampler, opener = Sampler(), zstandard.ZstdDecompressor()

        def signed(data, answers):
            slices = [(s, *shingled(s.column(1))) for s in opened(data)]
            known = np.unique(np.concatenate([s[2] for s in slices]))
            found = np.ones(len(known), "<i4")
            for g, i, j in stretches(known):
                if g in answers:
                    found[i:j] = np.ascontiguousarray(np.frombuffer(opener.decompress(answers[g]), np.uint8).reshape(4, j - i).T).view("<i4").ravel()
            for b, row, x, tf, whole in slices:
                sigs: list = [None] * b.num_rows
                df = found[np.searchsorted(known, x)]
                if len(x):
                    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    for r, s in zip(row[heads].tolist(), sampler.samples(x, weighed(idf, tf, df), heads)):
                        sigs[r] = s.tobytes()
                ends = np.searchsorted(row, np.arange(b.num_rows + 1)).tolist()
                own = [df[i:j].tobytes() for i, j in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(whole, pa.binary()), pa.array(sigs, pa.binary()), pa.array(own, pa.binary())], ["doc", "text", "copy", "sig", "df"])

        here, data, answers = None, None, {}
        for b in batches:
            for block, bucket, payload in zip(*(c.to_pylist() for c in b.columns)):
                if block != here:  # a block's own row comes before the answers
                    if data is not None:
                        yield from signed(data, answers)
                    here, data, answers = block, payload, {}
                else:
                    answers[bucket] = payload
        if data is not None:
            yield from signed(data, answers)

    with temporaries(docs.sparkSession) as keep:
        blocks = stored(docs.select(key, F.col(text).cast("string")).mapInArrow(freeze, "block long, data binary"), "uncompressed")
        asked = blocks.mapInArrow(ask, "bucket int, block long, data binary").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "block")
        answers = asked.mapInArrow(answer, "block long, bucket int, data binary")
        spread = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF) * 17, F.lit(buckets))  # evenly: a part's blocks apart
        both = blocks.select("block", F.lit(-1).alias("bucket"), "data").unionByName(answers).repartitionById(buckets, spread.cast("int"))
        return keep(both.sortWithinPartitions("block", "bucket").mapInArrow(sign, f"doc {kind}, text string, copy binary, sig binary, df binary"))


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float, kind: str, at_once: int = 200) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least threshold.

    b's text is sent once for every at_once of its partners, each partner's text once a pair; so a b with many
    partners is spread over many tasks.  texts: (doc, text, df), bucketed by doc, so that texts of no pair do not move."""
    spark = pairs.sparkSession
    hubs = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", F.ceil(F.col("n") / at_once).cast("int").alias("parts"))
    pairs = pairs.join(hubs, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    roles = pairs.select(F.col("a").alias("doc"), "b", "part", F.lit(1).alias("side"))
    roles = roles.union(hubs.select(F.col("b").alias("doc"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side")))
    sent = roles.join(texts, "doc").select("b", "part", "side", "doc", "text", "df")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        at, hub, hub_w, hub_sum = None, None, None, 0.0
        for whole in batches:
            for batch in groups_of_text([whole], 4, 1 << 20):
                row, x, tf, _ = shingled(batch.column(4))
                w = weighed(idf, tf, frequencies(batch.column(5)))
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                out = ([], [])
                for k, (b, part, side, doc) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                    mine, mine_w = x[ends[k] : ends[k + 1]], w[ends[k] : ends[k + 1]]
                    if side == 0:
                        at, hub, hub_w, hub_sum = (b, part), mine, mine_w, float(mine_w.sum())
                    elif at == (b, part) and len(mine) and len(hub):
                        place = np.minimum(np.searchsorted(hub, mine), len(hub) - 1)
                        both = hub[place] == mine
                        inner = float(np.minimum(mine_w[both], hub_w[place[both]]).sum())
                        if inner >= threshold * (hub_sum + float(mine_w.sum()) - inner) - 1e-9:
                            out[0].append(doc)
                            out[1].append(b)
                if out[0]:
                    yield pa.RecordBatch.from_pydict({"a": out[0], "b": out[1]}, schema=pa.schema([("a", batch.schema.field(3).type), ("b", batch.schema.field(0).type)]))

    ordered = sent.repartition(partitions(spark), "b", "part").sortWithinPartitions("b", "part", "side")
    return ordered.mapInArrow(compare, f"a {kind}, b {kind}")


def linked(members: DataFrame, texts: DataFrame, idf, threshold: float, kind: str, block: int = 2048, most_bytes: int = 16 << 20) -> DataFrame:
    """members (bucket, band, doc, root, sig) of buckets with several classes: links (a, b) that join all classes that
    a pair of documents of at least threshold joins, for every pair whose samples agree by HOPE at least.

    Pairs inside a bucket's largest class have nothing to say, so its documents meet only those of other classes: the
    others are dealt into blocks of about block documents and most_bytes of text, all documents likewise, and a task
    holds a block of the others while a block of all streams past.  It compares every such pair of different classes in the
    first band that the two share, unless links that the task has found join them.  So no list of pairs is made, a task
    gives fewer links than it has documents, and a large group of copies with a few strays costs its size times theirs."""
    near = stored(members.join(texts, "doc").select("bucket", "band", "doc", "root", "sig", "text", "df"))
    sizes = near.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    whole = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root", "size")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"))

    def parts(n, size):
        return F.greatest(F.lit(1), F.ceil(F.greatest(n / block, size / most_bytes))).cast("int")

    whole = whole.select("bucket", F.col("most.root").alias("major"), parts(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("few"), parts(F.col("n"), F.col("size")).alias("all"))
    rows = near.join(whole, "bucket").withColumn("main", F.col("root") == F.col("major"))
    turn, step = F.xxhash64("doc"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where(~F.col("main")).withColumn("i", F.pmod(turn, F.col("few")).cast("int")).withColumn("j", step("all")).withColumn("side", F.lit(0))
    right = rows.withColumn("j", F.pmod(turn, F.col("all")).cast("int")).withColumn("i", step("few")).withColumn("side", F.lit(1))
    columns = ["bucket", "i", "j", "side", "band", "doc", "root", "sig", "main", "text", "df"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        above: dict = {}  # roots that links found here join

        def top(r):
            while above.get(r, r) != r:
                r = above[r]
            return r

        def compare(held, sig, came, other, made):
            """held and came: (doc, root, main, shingles, weights, their sum) of both sides; sig and other: their samples."""
            docs = np.array([c[0] for c in came])
            free = np.array([c[2] for c in came])
            for u, (doc, root, _, x, w, total) in enumerate(held):
                same = other == sig[u]
                some = np.flatnonzero((same.sum(axis=1) >= HOPE * SAMPLES) & (free | (docs > doc)))
                if not len(some):
                    continue
                some = some[same[some].reshape(len(some), BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
                for v in some.tolist():
                    b, there, _, y, z, rest = came[v]
                    one, two = top(root), top(there)
                    if one == two:
                        continue
                    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    both = x[place] == y
                    inner = float(np.minimum(w[place[both]], z[both]).sum())
                    if inner >= threshold * (total + rest - inner) - 1e-9:
                        made.append((max(doc, b), min(doc, b)))
                        above[max(one, two)] = min(one, two)

        here, held, sigs, band, schema = None, [], [], 0, None
        for batch in batches:
            for b in groups_of_text([batch], 9, 1 << 20):
                schema = pa.schema([("a", b.schema.field("doc").type), ("b", b.schema.field("doc").type)])
                row, x, tf, _ = shingled(b.column(9))
                w = weighed(idf, tf, frequencies(b.column(10)))
                ends = np.searchsorted(row, np.arange(b.num_rows + 1))
                made, came, others = [], [], []

                def meet():
                    if held and came:
                        compare(held, np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, SAMPLES), came, np.frombuffer(b"".join(others), np.uint32).reshape(-1, SAMPLES), made)
                    came.clear()
                    others.clear()

                for k, (bucket, i, j, side, at, doc, root, sig, main) in enumerate(zip(*(b.column(c).to_pylist() for c in range(9)))):
                    if (bucket, i, j) != here:
                        meet()
                        here, held, sigs, band = (bucket, i, j), [], [], at
                        above.clear()
                    mine, weight = x[ends[k] : ends[k + 1]].copy(), w[ends[k] : ends[k + 1]].copy()
                    if side == 0:
                        held.append((doc, root, main, mine, weight, float(weight.sum())))
                        sigs.append(sig)
                    else:
                        came.append((doc, root, main, mine, weight, float(weight.sum())))
                        others.append(sig)
                meet()
                if made:
                    yield pa.RecordBatch.from_pydict({"a": [m[0] for m in made], "b": [m[1] for m in made]}, schema=schema)

    keys = ["bucket", "i", "j"]
    both = left.select(*columns).union(right.select(*columns))
    return both.repartition(partitions(members.sparkSession), *keys).sortWithinPartitions(*keys, "side").mapInArrow(run, f"a {kind}, b {kind}")


def contracted(edges: DataFrame, most: int = 400_000) -> DataFrame:
    """Of the edges (a, b) of each task: every node with the least one that they connect it with.

    A task holds at most about that many nodes; then it gives what it has and starts anew."""

    def run(batches):
        import pyarrow as pa

        above: dict = {}

        def root(x):
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        def settle(schema):
            nodes = [x for x in above if above[x] != x]
            return pa.RecordBatch.from_pydict({"a": nodes, "b": [root(x) for x in nodes]}, schema=schema)

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
            if len(above) >= most:
                yield settle(schema)
                above.clear()
        if above:
            yield settle(schema)

    return edges.mapInArrow(run, edges.schema)


def classes(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", idf=damped_idf) -> DataFrame:
    """(doc_id, class_id) of every row; class_id is the least doc_id of the class.  idf: a function of the number of
    documents and an array of document frequencies."""
    spark = docs.sparkSession
    small_batches(spark)
    with temporaries(spark) as keep:
        idf = max(1, docs.count()), idf
        rows = sampled(docs, idf, key, text)
        ids = stored(rows.where("doc is not null").groupBy("doc").agg(F.min("copy").alias("x"), F.max("copy").alias("y"), F.count(F.lit(1)).alias("n"), F.count("copy").alias("m")).where("n > 1"))
        if ids.where("x != y or m between 1 and n - 1").isEmpty():
            texts = rows.select("doc", "text", "df")
            return keep(grouped(texts if ids.isEmpty() else one_each(texts, ids.select("doc"), "doc", "text"), rows, idf, threshold))
        # Some ids stand for several texts: classes of rows first, then ids join the classes of their rows.
        numbered = stored(docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row")))
        rows = sampled(numbered, idf, "row", "text")
        found = grouped(rows.select("doc", "text", "df"), rows, idf, threshold)
        found = stored(found.join(numbered.select("row", "id"), found["doc_id"] == F.col("row")).select("id", F.col("class_id").alias("part")))
        first = found.where("id is not null").groupBy("id").agg(F.min("part").alias("least"))
        joins = components(found.join(first, "id").where("part != least").select(F.col("part").alias("a"), F.col("least").alias("b")))
        whole = stored(found.join(joins, found["part"] == joins["node"], "left").select("id", F.coalesce("root", "part").alias("part")))
        names = whole.groupBy("part").agg(F.min("id").alias("class_id"))
        out = whole.join(names, "part").select(F.col("id").alias("doc_id"), F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"))
        return keep(out)


def grouped(texts: DataFrame, rows: DataFrame, idf, threshold: float) -> DataFrame:
    """(doc_id, class_id) of every row of rows, the samples of documents; texts: (doc, text, df) of each id, once."""
    kind = rows.schema["doc"].dataType.simpleString()
    known = rows.where("doc is not null and copy is not null")
    copies = stored(known.groupBy("copy").agg(F.min("doc").alias("rep")))
    heads = stored(known.join(copies, "copy").where("doc = rep").select("doc", "sig").dropDuplicates(["doc"]))
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    buckets = stored(heads.select("doc", F.posexplode(band).alias("band", "bucket")))
    least = buckets.groupBy("bucket").agg(F.min("doc").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "b")
    members = stored(buckets.join(least, "bucket"))
    texts = bucketed(texts, "doc", members)
    first = stored(verified(members.where("doc != b").select(F.col("doc").alias("a"), "b").distinct(), texts, idf, threshold, kind))
    # Buckets that hold several classes yet: once more against one document, the least by hash of those that the first
    # comparison left out; then every pair of different classes whose samples agree, once, within tasks.
    # Stars (node, root) stand for settled links.
    def mixed_buckets(roots):
        placed = members.join(roots, members["doc"] == roots["node"], "left").select("bucket", "band", "doc", F.coalesce("root", "doc").alias("root"))
        several = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket", "x")
        return stored(placed.join(several, "bucket"))

    def joined(roots, new):
        if new.isEmpty():
            return roots
        return stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new), contract=contracted))

    roots = stored(components(first, contract=contracted))
    rest = mixed_buckets(roots)
    hubs = rest.where("root != x").groupBy("bucket").agg(F.min_by(F.struct("doc", "root"), F.xxhash64("doc")).alias("hub"))
    more = rest.join(hubs, "bucket").where("root != hub.root").select(F.greatest("doc", "hub.doc").alias("a"), F.least("doc", "hub.doc").alias("b")).distinct()
    roots = joined(roots, stored(verified(stored(more), texts, idf, threshold, kind)))
    rest = mixed_buckets(roots).join(heads, "doc").select("bucket", "band", "doc", "root", "sig")
    roots = joined(roots, stored(linked(rest, texts, idf, threshold, kind)))
    by_copy = copies.join(roots, copies["rep"] == roots["node"], "left").select("copy", F.coalesce("root", "rep").alias("root"))
    out = rows.join(by_copy, "copy", "left")
    return out.select(F.col("doc").alias("doc_id"), F.when(F.col("doc").isNotNull(), F.coalesce("root", "doc")).alias("class_id"))


def kept_documents(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", idf=damped_idf) -> DataFrame:
    """The rows of docs, all columns, of the least id of each class, one row of an id, and the rows without id."""
    found = classes(docs, threshold, key, text, idf)
    gone = found.where("doc_id != class_id").select("doc_id").distinct()
    out = docs.join(gone, docs[key] == gone["doc_id"], "left_anti")
    twice = found.where("doc_id = class_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    return out if twice.isEmpty() else one_each(out, twice, key, text)


def one_each(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """docs with one row, that of the least hash of its text, for each of the ids; combined before the shuffle."""
    ids = ids.toDF(name := fresh("_id", docs.columns))
    alone, several = (docs.join(ids, docs[key] == ids[name], how) for how in ("left_anti", "left_semi"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return alone.unionByName(several.groupBy(F.col(key).alias("_id")).agg(F.min_by(row, F.coalesce(F.xxhash64(text), F.lit(0))).alias("_row")).select("_row.*"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row with its class; of rows that repeat an id one is kept."""
    found = classes(table(spark, sf_dir, "documents"), idf=smooth_idf)
    kept = F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))
    twice = stored(found.where("doc_id is not null").groupBy("doc_id", "class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if twice.isEmpty():
        return found.select("doc_id", "class_id", kept.alias("kept"))
    # Rows that repeat an id have one class and are alike here: as many come out, the first of them kept.
    alone = found.join(twice.select("doc_id"), "doc_id", "left_anti").select("doc_id", "class_id", kept.alias("kept"))
    steps = twice.withColumn("from", F.explode(F.expr("sequence(1, n, 10000)")))  # so that no row grows with n
    rows = steps.withColumn("i", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + 9999, F.col("n")))))
    return alone.unionByName(rows.select("doc_id", "class_id", (kept & (F.col("i") == 1)).alias("kept")))
