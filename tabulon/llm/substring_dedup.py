"""Substring deduplication by super-k-mer partitioning.

A window is k consecutive words.  Its minimiser is the least hash of the m-word runs inside it.
Consecutive windows of a document that share their minimiser form a super-k-mer, whose words travel
as one packed string to the minimiser's bucket; equal windows always meet there.  In the bucket,
windows are counted exactly (words are numbered, pairs of numbers renumbered up to k words, then
sorted) and each gets the least document id that holds it.  A document's word goes if a window over
it also starts in a document with a smaller id.

Documents are first frozen in blocks (a table in the shared folder).  A block then asks the buckets which of its
minimisers any other document has; equal windows have equal minimisers, so the super-k-mers of the others need not
travel.  It sends each distinct remaining super-k-mer once, with the least and largest id that hold it there, and gets
back only windows that change something; so copies and common passages cost one string a block, however many
documents hold them.

Defined cases: a null or empty text has no words; fewer than k words make no window; ids are integers (anything else
is a TypeError); a null id counts as larger than all others, like 2^63 - 1; rows with the same id never remove each other's words; repeated windows
inside one document stay; an empty table gives an empty result; all columns of the input are kept
(one named as an output count is replaced by it); texts of any length are handled whole.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import groups_of_text, partitions, small_batches, stored, table, trimmed
from .words import Words, mixed

LAST = (1 << 63) - 1
BLOCK_BYTES = 4 << 20


def super_kmers(column, k: int, m: int, buckets: int):
    """Of a block of texts: its Words, and the runs of windows that share a minimiser as arrays (document, first word,
    number of windows, key); a key is the minimiser's bucket and 32 bits of its hash."""
    import numpy as np

    w = Words(column)
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(w.first))
    at = np.flatnonzero(row[: n - k + 1] == row[k - 1 :]) if n >= k else none
    if not len(at):
        return w, (none, none, none, none.astype(np.uint64))
    least, width, have = w.runs(m), k - m + 1, 1
    while have < width:  # least over width neighbours, by doubling
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(new)
    value = mixed(value[starts])  # least hashes are small; mixed again they fill the buckets evenly
    bucket = ((value >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    key = (bucket << np.uint64(32)) | (value & np.uint64(0xFFFFFFFF))
    return w, (row[at[starts]], at[starts], np.diff(np.append(starts, len(at))), key)


def asked(runs, ids):
    """Distinct keys of a block in order, and whether two ids or more have each there."""
    import numpy as np

    order = np.argsort(runs[3], kind="stable")
    key, mine = runs[3][order], ids[runs[0]][order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    if not len(heads):
        return key, np.zeros(0, bool)
    return key[heads], np.minimum.reduceat(mine, heads) != np.maximum.reduceat(mine, heads)


def by_bucket(key):
    """(bucket, from, to) of the stretches of sorted keys."""
    import numpy as np

    bucket = (key >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    return zip(bucket[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(bucket)).tolist())


def packed(w: Words, runs, ids, k: int):
    """Distinct packed strings by bucket, {bucket: ([strings], [least ids], [largest ids])}, and each run's bucket and place there."""
    line, start, end = w.spaced()
    doc, first, count, key = runs
    out: dict = {}
    places, seen = [], {}
    for a, z, g, d in zip(start[first].tolist(), end[first + count + k - 2].tolist(), (key >> 32).tolist(), ids[doc].tolist()):
        s = line[a:z]
        place = seen.get(s)
        if place is None:
            rows = out.get(g)
            if rows is None:
                rows = out[g] = ([], [], [])
            place = seen[s] = g, len(rows[0])
            for values, x in zip(rows, (s, d, d)):
                values.append(x)
        else:
            rows, e = out[g], place[1]
            if d < rows[1][e]:
                rows[1][e] = d
            elif d > rows[2][e]:
                rows[2][e] = d
        places.append(place)
    return out, places


def shared_windows(members: list, k: int):
    """members: (strings joined by line feeds, least ids, largest ids) of one bucket's blocks.  For each, arrays (string,
    offset, least id) of the windows that a smaller id than the string's largest holds."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    sizes = [len(x[1]) for x in members]
    low, high = (np.concatenate([np.asarray(x[i], np.int64) for x in members]) for i in (1, 2))
    owner = np.repeat(np.arange(len(members)), sizes)
    inside = np.concatenate([np.arange(n) for n in sizes])
    whole = b"\n".join(x[0] for x in members)
    cuts = np.flatnonzero(np.frombuffer(whole, np.uint8) == 10)
    offs = np.concatenate([[0], cuts + 1, [len(whole)]]).astype(np.int64)
    strings = pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(whole)])
    w = Words(strings)
    codes, have = w.numbered()[0].astype(np.int64), 1
    while have < k:  # numbers of runs of 1, 2, 4 ... k words; equal numbers, equal words
        step = min(have, k - have)
        codes = pd.factorize(codes[: len(codes) - step] * (int(codes.max()) + 1) + codes[step:])[0].astype(np.int64)
        have += step
    row = np.repeat(np.arange(len(offs) - 1), np.diff(w.first))
    at = np.flatnonzero(row[: len(codes)] == row[k - 1 :])
    window, row, place = codes[at], row[at], at - w.first[row[at]]
    order = np.argsort(window, kind="stable")
    heads = np.flatnonzero(np.append(True, window[order][1:] != window[order][:-1]))
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[row[order]], heads), np.diff(np.append(heads, len(order))))
    hit = np.flatnonzero(least < high[row])
    who = row[hit]
    out = {}
    for o in np.unique(owner[who]).tolist():
        mine = owner[who] == o
        out[o] = inside[who[mine]], place[hit][mine], least[hit][mine]
    return out


def numbers(*arrays) -> bytes:
    """Integer arrays of equal length as compressed bytes, differences of neighbours first."""
    import numpy as np
    import zstandard

    raw = b"".join(np.diff(np.asarray(a, np.int64), prepend=0).astype("<i8").reshape(-1, 1).view(np.uint8).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(3).compress(raw)


def arrays_of(data: bytes, count: int):
    import numpy as np
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // (8 * count)
    return [np.cumsum(np.ascontiguousarray(x.reshape(8, n).T).view("<i8").ravel()) for x in raw.reshape(count, 8 * n)] if n else [np.zeros(0, np.int64)] * count


def without_repeats(docs: DataFrame, k: int = 13, m: int = 4, key: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_words", "n_removed"), spaced: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of docs with text replaced by its kept words joined by one space where any word went (with spaced:
    everywhere but in nulls), and the two counts.  Rows and other columns are kept as they are; input columns of the
    counts' names give way to them.  A window that all blocks of block_bytes of text hold costs its bucket a string a
    block, so larger blocks suit larger tables (a task needs about 30 times a block's bytes)."""
    spark = docs.sparkSession
    small_batches(spark, 500, 4 << 20)  # a batch is held thrice: by the executor, by Arrow and as objects
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {x.lower() for x in counts}])
    names, at_key, at_text = docs.columns, docs.columns.index(key), docs.columns.index(text)
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} is {docs.schema[key].dataType.simpleString()}; integers are needed")
    buckets = partitions(spark)

    def freeze(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        press = zstandard.ZstdCompressor(3)

        def block():
            nonlocal n, held, size
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema) as w:
                w.write_table(whole)
            n, held, size = n + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), pa.array([press.compress(sink.getvalue())], pa.binary())], ["block", "data"])

        for b in groups_of_text(batches, at_text, block_bytes):
            held.append(b)
            size += b.nbytes
            if size >= block_bytes:
                yield block()
        if held:
            yield block()

    def rows_of(data: bytes):
        """A block's rows and ids."""
        import numpy as np
        import pyarrow as pa
        import zstandard

        whole = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all().combine_chunks()
        return whole, np.asarray(whole.column(at_key).cast(pa.int64()).fill_null(LAST).to_numpy())

    def opened(data: bytes):
        """A block's rows, ids, Words and runs."""
        import pyarrow as pa

        whole, ids = rows_of(data)
        column = whole.column(at_text).chunk(0) if whole.num_rows else pa.array([], pa.string())
        return whole, ids, *super_kmers(column, k, m, buckets)

    def keys_of(data: bytes):
        """A block's runs and ids as opened() gives them, but of the runs only documents and keys: the words of a slice
        of the block are let go before the next."""
        import numpy as np

        whole, ids = rows_of(data)
        runs, before = [], 0
        for part in groups_of_text(whole.to_batches(), at_text, 1 << 20):
            row, _, _, key = super_kmers(part.column(at_text), k, m, buckets)[1]
            runs.append((row + before, key))
            before += part.num_rows
        row, key = (np.concatenate([r[i] for r in runs]) for i in (0, 1)) if runs else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        return (row, None, None, key), ids

    def ask(batches):
        import numpy as np
        import pyarrow as pa

        trimmed()
        for b in batches:
            for number, data in ((x.as_py(), y.as_py()) for x, y in zip(b.column(0), b.column(1))):
                found, several = asked(*keys_of(data))
                found = [(g, numbers((found[i:j] & np.uint64(0xFFFFFFFF)).astype(np.int64), several[i:j])) for g, i, j in by_bucket(found)]
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.int32()), pa.array([number] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())], ["bucket", "block", "data"])

    def answer(batches):
        """Bits, for each block's keys of a bucket, of those that another block or several ids of the block have."""
        import numpy as np
        import pyarrow as pa

        def settle(bucket, held):
            parts = [arrays_of(data, 2) for _, data in held]
            sizes = [len(x) for x, _ in parts]
            key, several = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            met = several.astype(bool)
            met[order[1:]] |= same
            met[order[:-1]] |= same
            bits = [np.packbits(x).tobytes() if x.any() else None for x in np.split(met, np.cumsum(sizes)[:-1])]
            some = [i for i, x in enumerate(bits) if x is not None]
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in some], pa.int64()), pa.array([bucket] * len(some), pa.int32()), pa.array([bits[i] for i in some], pa.binary())], ["block", "bucket", "data"])

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

    def met(runs, ids, bits):
        """The runs whose keys the answers (bucket, bits) name."""
        import numpy as np

        found, _ = asked(runs, ids)
        on, answers = np.zeros(len(found), bool), dict(bits)
        for g, i, j in by_bucket(found):
            if g in answers:
                on[i:j] = np.unpackbits(np.frombuffer(answers[g], np.uint8), count=j - i).astype(bool)
        some = np.flatnonzero(on[np.searchsorted(found, runs[3])]) if len(found) else np.zeros(0, np.int64)
        return tuple(x[some] for x in runs)

    def with_rows(batches):
        """(block, its data, its rows): a block's own row comes before the others."""
        data, rows, here = None, [], None
        trimmed()
        for b in batches:
            for block, bucket, payload in zip(*(c.to_pylist() for c in b.columns)):
                if bucket == -1:
                    if data is not None:
                        yield here, data, rows
                    data, rows, here = payload, [], block
                elif block == here:
                    rows.append((bucket, payload))
        if data is not None:
            yield here, data, rows

    def send(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(3)
        for number, data, bits in with_rows(batches):
            if not bits:
                continue
            _, ids, w, runs = opened(data)
            rows, _ = packed(w, met(runs, ids, bits), ids, k)
            where = sorted(rows)
            strings = [press.compress(b"\n".join(rows[g][0])) for g in where]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([number] * len(where), pa.int64()), pa.array(strings, pa.binary()), pa.array([numbers(*rows[g][1:]) for g in where], pa.binary())], ["bucket", "block", "strings", "numbers"])

    def count(batches):
        import pyarrow as pa
        import zstandard

        def settle(bucket, held):
            opener = zstandard.ZstdDecompressor()
            found = shared_windows([(opener.decompress(strings), *arrays_of(rest, 2)) for _, strings, rest in held], k)
            return pa.RecordBatch.from_arrays([pa.array([held[o][0] for o in found], pa.int64()), pa.array([bucket] * len(found), pa.int32()), pa.array([numbers(*x) for x in found.values()], pa.binary())], ["block", "bucket", "data"])

        here, held = None, []
        for b in batches:
            for bucket, block, strings, rest in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != here:
                    if held:
                        yield settle(here, held)
                    here, held = bucket, []
                held.append((block, strings, rest))
        if held:
            yield settle(here, held)

    def gone(w, runs, ids, hits):
        """Whether each word goes, given the hits (bucket, windows) and bits (-2 - bucket, bits) of its block."""
        import numpy as np

        edge = np.zeros(len(w.hash) + 1, np.int64)
        runs = met(runs, ids, [(-2 - g, x) for g, x in hits if g < 0])
        _, places = packed(w, runs, ids, k)
        known: dict = {}
        for g, found in hits:
            if g >= 0:
                string, offset, least = arrays_of(found, 3)
                order = np.argsort(string, kind="stable")
                string, offset, least = string[order], offset[order], least[order]
                heads = np.flatnonzero(np.append(True, string[1:] != string[:-1]))
                for e, a, z in zip(string[heads].tolist(), heads.tolist(), np.append(heads[1:], len(string)).tolist()):
                    known[g, e] = offset[a:z], least[a:z]
        for i, place in enumerate(places):
            got = known.get(place)
            if got is not None:
                at = runs[1][i] + got[0][got[1] < ids[runs[0][i]]]
                edge[at] += 1  # windows of one run begin at different words
                edge[at + k] -= 1
        return np.cumsum(edge)[:-1] > 0

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for _, data, hits in with_rows(batches):
            whole, ids, w, runs = opened(data)
            away = gone(w, runs, ids, hits) if any(g >= 0 for g, _ in hits) else np.zeros(len(w.hash), bool)
            removed = np.diff(np.append(0, np.cumsum(away))[w.first])
            texts = whole.column(at_text).to_pylist()
            change = np.flatnonzero((removed > 0) | (spaced and np.array([t is not None for t in texts], bool)))
            if len(change):
                line, start, end = w.spaced()
                step = np.flatnonzero(np.diff(np.concatenate([[True], away, [True]]).astype(np.int8)))
                edges = np.union1d(step, w.first)  # stretches of one kind inside one text
                for i in change.tolist():
                    some = edges[np.searchsorted(edges, w.first[i]) : np.searchsorted(edges, w.first[i + 1]) + 1]
                    texts[i] = b" ".join([line[start[a] : end[z - 1]] for a, z in zip(some[:-1].tolist(), some[1:].tolist()) if not away[a]]).decode()
            columns = list(whole.columns)
            columns[at_text] = pa.array(texts, whole.schema.field(at_text).type)
            yield from pa.Table.from_arrays([*columns, pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64())], [*names, *counts]).to_batches(500)

    def to_buckets(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "block")

    def to_blocks(rows: DataFrame) -> DataFrame:
        both = blocks.select("block", F.lit(-1).alias("bucket"), "data").unionByName(rows)
        spread = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF) * 17, F.lit(partitions(spark)))  # evenly: a part's blocks apart
        return both.repartitionById(partitions(spark), spread.cast("int")).sortWithinPartitions("block", F.col("bucket") != -1, "bucket")

    blocks = stored(docs.mapInArrow(freeze, "block long, data binary"), "uncompressed")
    bits = stored(to_buckets(blocks.mapInArrow(ask, "bucket int, block long, data binary")).mapInArrow(answer, "block long, bucket int, data binary"))
    sent = to_blocks(bits).mapInArrow(send, "bucket int, block long, strings binary, numbers binary")
    hits = to_buckets(sent).mapInArrow(count, "block long, bucket int, data binary")
    again = bits.select("block", (-2 - F.col("bucket")).alias("bucket"), "data")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in counts)])
    return to_blocks(hits.unionByName(again)).mapInArrow(cut, schema)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), spaced=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as x from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)),
least as (select x, min(doc_id) as d from win group by x having count(distinct doc_id) > 1),
hit as (select win.doc_id, i from win join least using (x) where d < win.doc_id),
gone as (select distinct doc_id, i + k as p from hit, (select unnest(range(0, 13)) as k)),
kept as (
  select doc_id, string_agg(word, ' ' order by p) as t
  from (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w) anti join gone using (doc_id, p)
  group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (select count(*) from gone g where g.doc_id = w.doc_id)::bigint as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)
"""
