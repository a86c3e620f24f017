"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

A text is cut into chunks that tokens never cross (an optional space and what follows up to white
space, or a run of white space).  Chunks new to the worker are split by the tokenizer's pattern, and the pieces at
every place that no token of the vocabulary found there spans, as no merge can cross it; the
distinct parts become token-position rows of a DuckDB table.  A recursive query joins neighbouring
tokens with the merge table, contracts the leftmost pair of least rank of each part, and ends when no part has a pair
left.  (In parts of over SHORT_BYTES a round also contracts the other disjoint occurrences of that pair, which the next
rounds would do, so that long runs of a character take few rounds; the ids are the same.)  An ordered aggregation of
token bytes decodes.  Texts are then put together from the chunks.

Chunks and parts already encoded are remembered by the worker, up to a number of bytes.

Defined cases: null counts as empty (no tokens, the hash of nothing); repeated rows give repeated
results; texts of any length are encoded whole; an empty table gives an empty result; only the key
and text columns are read, so other columns' names cannot clash.
"""
from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import groups_of_text, small_batches, table, worker_state
from .words import Pieces, laid_out, text_bytes

#: Fixed value: characters that the pattern's \s stands for (Unicode White_Space).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SHORT_BYTES = 64


def white_characters(data, n: int):
    """Of n bytes of UTF-8 text: whether each belongs to a white character, and where each of those begins."""
    import numpy as np

    a, b, c = data[:n], data[1 : n + 1], data[2 : n + 2]
    head = (a == 32) | ((a >= 9) & (a <= 13))
    white = head.copy()
    wide = np.flatnonzero((a == 0xC2) | (a == 0xE1) | (a == 0xE2) | (a == 0xE3))
    x, y, z = a[wide], b[wide], c[wide]
    two = wide[(x == 0xC2) & ((y == 0x85) | (y == 0xA0))]
    dots = (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
    three = wide[dots | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE3) & (y == 0x80) & (z == 0x80)]
    head[two] = head[three] = True
    for at, size in ((two, 2), (three, 3)):
        for k in range(size):
            white[at + k] = True
    return white, np.flatnonzero(head)


def chunked(column) -> Pieces:
    """The chunks of a text column: ` ?[^WHITE]+|[WHITE]+(?![^WHITE])|[WHITE]+`, matched one after the other."""
    import numpy as np

    data, offs = text_bytes(column)
    n = int(offs[-1])
    white, heads = white_characters(data, n)
    edge, cut = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    edge[offs] = True
    solid = ~white
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= edge[1:-1] | white[:-1]
    stop[:-1] &= edge[1:-1] | white[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    cut[offs] = cut[end] = True  # white space begins where a word or a text ends
    after = start[~edge[start]]  # words behind white space: its last character stands alone, or goes with the word if it is a space
    last = heads[np.searchsorted(heads, after) - 1]
    cut[last] = True
    cut[after[data[last] != 32]] = True
    start = np.flatnonzero(cut[:n])
    return Pieces(data, start, np.append(start[1:], n) if len(start) else start, np.searchsorted(start, offs))


class Memory:
    """(ids, bytes) by key in a young and an old generation of about most bytes each: a full young one becomes the old
    one, and what is met again moves back, so that frequent keys stay."""

    def __init__(self, most: int):
        self.most, self.size, self.young, self.old = most, 0, {}, {}

    def known(self, keys: list[bytes]) -> list:
        """The value of each key, None for those not there."""
        out = list(map(self.young.get, keys))
        back = {}
        for k, v in enumerate(out):
            if v is None and (v := self.old.get(keys[k])) is not None:
                out[k] = back[keys[k]] = v
        self.learn(back)
        return out

    def learn(self, values: dict) -> None:
        self.young |= values
        self.size += 300 * len(values) + 6 * sum(map(len, values))  # a value has at most five bytes for one of its key
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0


class Encoder:
    """Encodes pieces by ranks; one per worker process.  most: bytes of chunks to remember, and a fourth of that for parts,
    twice each; step: bytes of parts to one query."""

    def __init__(self, ranks_path: str, pattern: str, most: int = 150 << 20, step: int = 400_000, memory: str = "300MB"):
        import base64
        import tempfile

        import ahocorasick
        import duckdb
        import pyarrow as pa
        import regex

        self.tokens = [b""] * sum(1 for _ in open(ranks_path, "rb"))
        for line in open(ranks_path, "rb"):
            token, rank = line.split()
            self.tokens[int(rank)] = base64.b64decode(token)
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        pairs = []
        for r, t in enumerate(self.tokens):
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    pairs.append((a, b, r))
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*pairs))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "preserve_insertion_order": False, "temp_directory": tempfile.gettempdir()})
        made = pa.table({"k": pa.compute.add(pa.compute.multiply(a.cast("int64"), 1 << 20), b.cast("int64")), "r": r})  # noqa: F841
        self.db.execute("create table merges as select k, r from made")
        names = pa.table({"r": pa.array(range(len(self.tokens)), pa.int32()), "h": pa.array(self.tokens, pa.binary())})  # noqa: F841
        self.db.execute("create table names as select r, h from names")
        self.single = [self.rank[bytes([i])] for i in range(256)]
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.found = ahocorasick.Automaton()
        for t in self.tokens:
            if len(t) > 1:
                self.found.add_word(t.decode("latin-1"), len(t))
        self.found.make_automaton()
        self.step, self.chunks, self.parts = step, Memory(most), Memory(most // 4)

    #: Rows (w, i, t, n): part, position, token, round.  Each round joins neighbours with the merges, takes the least
    #: rank and then the leftmost position of each part (packed into one number), and contracts there.  A part without
    #: a pair drops out; its last round is its encoding.  Positions rise over the whole table, so one ordering serves all.
    SHORT = """
    with recursive run as (
      select w, i, t, 0 as n from start
      union all
      (with a as materialized (select w, i, t, n, lead(t) over o as t2, lead(w) over o as w2, lag(i) over o as before from run window o as (order by i)),
            c as (select w, min((r::bigint << 40) + i) as best from a join merges on k = t::bigint * 1048576 + t2 where w = w2 group by w)
       select a.w, i, case when i = (best & 1099511627775) then (best >> 40)::int else t end, n + 1
       from a join c on a.w = c.w where before is null or before != (best & 1099511627775)))
    """
    #: For long parts a round contracts all disjoint occurrences of the leftmost least pair, as the next rounds would do,
    #: so that a run of one character takes few rounds.
    LONG = """
    with recursive run as (
      select w, i, t, 0 as n from start
      union all
      select w, i, coalesce(r, t), n + 1 from (
        select w, i, t, n, r, coalesce(lag(r is not null) over (partition by w order by i), false) as gone from (
          select w, i, t, n,
                 case when k is not null and (row_number() over (partition by w, k, i - q order by i)) % 2 = 1 then k end as r
          from (
            select *, case when k is not null then row_number() over (partition by w, k order by i) end as q from (
              select w, j as i, t, n, case when r = least_r then r end as k from (
                select w, t, n, r, row_number() over (partition by w order by i) as j, min(r) over (partition by w) as least_r
                from (select w, i, t, n, t::bigint * 1048576 + lead(t) over (partition by w order by i) as pair from run)
                left join merges on k = pair)
              where least_r is not null))))
      where not gone)
    """
    LAST = """
    select w, list({'t': t, 'h': h} order by i)
    from (select w, i, t from run join (select w, max(n) as n from run group by w) using (w, n)) join names on r = t
    group by w
    """

    def divided(self, piece: bytes) -> list[bytes]:
        """piece, cut where no token that occurs in it spans the place; short ones are as quick whole."""
        if len(piece) <= 24:
            return [piece]
        free = bytearray(b"\1") * len(piece)  # whether a cut before each byte is free
        for end, size in self.found.iter(piece.decode("latin-1")):
            free[end - size + 2 : end + 1] = bytes(size - 1)
        out, at = [], 0
        while (cut := free.find(1, at + 1)) > 0:
            out.append(piece[at:cut])
            at = cut
        return [*out, piece[at:]]

    def encode_parts(self, parts: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Of each part: its ids as little-endian 32-bit, and the bytes that they decode to."""
        import numpy as np
        import pyarrow as pa

        out = {p: (r.to_bytes(4, "little"), p) for p in parts if (r := self.rank.get(p)) is not None}
        rest = sorted((p for p in parts if p not in out), key=len)
        at = 0
        while at < len(rest):
            size, end, short = 0, at, len(rest[at]) <= SHORT_BYTES
            while end < len(rest) and (end == at or size + len(rest[end]) <= self.step) and (len(rest[end]) <= SHORT_BYTES) == short:
                size, end = size + len(rest[end]), end + 1
            part, at = rest[at:end], end
            lengths = np.array([len(p) for p in part])
            flat = np.frombuffer(b"".join(part), np.uint8)
            start = pa.table({"w": np.repeat(np.arange(len(part), dtype=np.int32), lengths), "i": np.arange(len(flat), dtype=np.int64), "t": np.array(self.single, np.int32)[flat]})
            self.db.register("start", start)
            got = self.db.sql((self.SHORT if short else self.LONG) + self.LAST).to_arrow_table()
            self.db.unregister("start")
            where, lists = (got.column(i).combine_chunks() for i in range(2))
            offs = lists.offsets.to_numpy()
            ids, blobs = lists.values.field(0).to_numpy(zero_copy_only=False).astype("<u4").tobytes(), lists.values.field(1).cast(pa.large_binary())
            ends = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
            data, base, cuts = blobs.buffers()[2].to_pybytes(), (4 * offs).tolist(), ends[offs].tolist()
            for k, w in enumerate(where.to_pylist()):
                out[part[w]] = ids[base[k] : base[k + 1]], data[cuts[k] : cuts[k + 1]]
        return out

    def values(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded bytes of distinct chunks."""
        out = self.chunks.known(chunks)
        new = [k for k, v in enumerate(out) if v is None]
        split = [[p.encode() for p in self.pieces.findall(chunks[k].decode("utf-8"))] for k in new]
        cut = {p: d for p in set(itertools.chain.from_iterable(split)) if len(d := self.divided(p)) > 1}
        if cut:  # parts of divided pieces recur in other pieces
            parts = list(set(itertools.chain.from_iterable(cut.values())))
            have = dict(zip(parts, self.parts.known(parts)))
            made = self.encode_parts([p for p, v in have.items() if v is None])
            self.parts.learn(made)
            have |= made
        known = self.encode_parts(list({p for parts in split for p in parts if p not in cut}))
        known |= {p: tuple(map(b"".join, zip(*[have[x] for x in d]))) for p, d in cut.items()}
        for k, parts in zip(new, split):
            out[k] = known[parts[0]] if len(parts) == 1 else tuple(map(b"".join, zip(*[known[p] for p in parts]))) or (b"", b"")
        self.chunks.learn({chunks[k]: out[k] for k in new})
        return out

    def encode(self, column) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each text of an Arrow column: the distinct chunks' values, laid out in the order of the chunks."""
        cut = chunked(column)
        codes, first = cut.numbered()
        values = self.values(cut.bytes(first))
        return list(zip(*(laid_out([v[k] for v in values], codes, cut.first, width) for k, width in ((0, 4), (1, 1)))))


def encoded(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", keep: str = "digest") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every text; with keep="digest" the SHA-256 of both instead."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if keep == "digest" else "ids binary, decoded binary"

    def run(batches):
        import hashlib

        import pyarrow as pa

        enc = worker_state(f"bpe {ranks_path}", lambda: Encoder(ranks_path, pattern))
        for b in groups_of_text(batches, 1):
            got = enc.encode(b.column(1))
            counts = pa.array([len(i) // 4 for i, _ in got], pa.int64())
            if keep == "digest":
                rest = [pa.array([hashlib.sha256(x[k]).hexdigest() for x in got], pa.string()) for k in (0, 1)]
            else:
                rest = [pa.array([x[k] for x in got], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), counts, *rest], [key, "n_tokens", *(("ids_sha256", "decoded_sha256") if keep == "digest" else ("ids", "decoded"))])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, n_tokens long, {tail}")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
