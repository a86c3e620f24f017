"""TIFF files in binary columns: written, walked and decoded page by page.

decoded() walks a file's image directories (either byte order), decodes strips or tiles stored plain
or with PackBits, LZW or deflate, undoes the horizontal predictor and returns one row per page.  It reads 8- and 16-bit
samples, interleaved or in separate planes, and bilevel ones (a byte each, 0 or 1); 16-bit samples come out little-endian.
stored_bytes() writes bytes losslessly as 8-bit samples in such a file.

Defined cases: null content, or a file whose directories cannot be walked, gives one row with page null and the error's
text after the pages before it; a page that cannot be decoded gives a row with its number and the error, and the walk
goes on; a file without directories gives no page; repeated rows give repeated pages; directories that point back
end the walk; an empty table gives an empty result; only the named columns are read.
"""
from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import groups_of_text, small_batches, table

#: Fixed values of the TIFF 6.0 format: tags, field sizes, compression codes.
WIDTH, HEIGHT, DEPTH, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_SIZE = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE = 284, 317, 322, 323, 324, 325
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


def packbits(data: bytes) -> bytes:
    """PackBits coding: runs of three or more as (1 - n, byte), the rest as literals of up to 128."""
    import numpy as np

    x = np.frombuffer(data, np.uint8)
    cuts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])
    size = np.diff(cuts)
    long = np.flatnonzero(size >= 3)
    out, at = [], 0

    def literals(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(bytes((len(part) - 1,)) + part)

    for start, n in zip(cuts[long].tolist(), size[long].tolist()):
        literals(start)
        whole, rest = divmod(n, 128)
        out.append(bytes((129, data[start])) * whole)
        at = start + n
        if rest >= 2:
            out.append(bytes((257 - rest, data[start])))
        else:
            at -= rest  # a single byte goes with the literals after it
    literals(len(data))
    return b"".join(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size:
        if i >= len(data):
            raise ValueError("PackBits data ends early")
        n, i = data[i], i + 1
        if n < 128:
            if i + n + 1 > len(data):
                raise ValueError("PackBits data ends early")
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            if i >= len(data):
                raise ValueError("PackBits data ends early")
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out[:size])


def lzw(data: bytes) -> bytes:
    """TIFF LZW: most significant bit first, 9 to 12 bits, the width grows with entries 511, 1023 and 2047."""
    import numpy as np

    codes, lengths = [256], []  # lengths: codes up to and with each clear code
    book: dict = {}
    free, w = 258, -1
    for c in data:
        if w < 0:
            w = c
            continue
        key = w << 8 | c
        known = book.get(key)
        if known is not None:
            w = known
            continue
        codes.append(w)
        book[key] = free
        free += 1
        if free == 4094:
            codes.append(256)
            lengths.append(len(codes))
            book.clear()
            free = 258
        w = c
    if w >= 0:
        codes.append(w)
    codes.append(257)
    # A code's width follows from its place after the clear code: the k-th one is written when k entries exist.
    starts = np.array([1, *lengths])
    place = np.arange(len(codes))
    since = place - starts[np.searchsorted(starts, place, side="right") - 1]
    width = 9 + (since >= 254).astype(int) + (since >= 766) + (since >= 1790)
    width[0] = 9
    bits = np.unpackbits((np.array(codes, np.uint16) << 4).astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, :12]
    return np.packbits(bits[np.arange(12) >= 12 - width[:, None]]).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, book, width, before = bytearray(), list(first), 9, None
    acc = held = i = 0
    while len(out) < size:
        while held < width:
            if i >= len(data):
                raise ValueError("LZW data ends early")
            acc, held, i = ((acc << 8) | data[i]) & 0xFFFFFFFF, held + 8, i + 1
        code = (acc >> (held - width)) & ((1 << width) - 1)
        held -= width
        if code == 257:
            break
        if code == 256:
            book, width, before = list(first), 9, None
            continue
        if before is None:
            word = book[code] if code < len(book) else None
        elif code < len(book):
            word = book[code]
        else:
            word = before + before[:1] if code == len(book) else None
        if not word:
            raise ValueError("LZW code out of range")
        out += word
        if before is not None:
            book.append(before + word[:1])
            if len(book) >= (1 << width) - 1 and width < 12:
                width += 1
        before = word
    if len(out) < size:
        raise ValueError("LZW data ends early")
    return bytes(out[:size])


def differences(data: bytes, width: int, samples: int = 1, undo: bool = False) -> bytes:
    """The horizontal predictor on 8-bit samples, applied or undone row by row."""
    import numpy as np

    rows = np.frombuffer(data, np.uint8).reshape(-1, width, samples)
    if undo:
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out.tobytes()


def directories(blob: bytes):
    """Yields ({tag: values}, byte order) of each image directory in file order."""
    order = {b"II": "<", b"MM": ">"}.get(blob[:2])
    if order is None or len(blob) < 8 or struct.unpack(order + "H", blob[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", blob[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        if at + 2 > len(blob):
            raise ValueError("directory outside the file")
        (count,), fields = struct.unpack_from(order + "H", blob, at), {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * k)
            size = SIZES.get(kind, 1) * n
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", blob, at + 10 + 12 * k)[0]
            if where + size > len(blob):
                raise ValueError("field outside the file")
            if kind in (1, 3, 4):
                fields[tag] = struct.unpack_from(f"{order}{n}{' BxHI'[kind]}", blob, where)
            else:
                fields[tag] = (blob[where : where + size],)
        yield fields
        at = struct.unpack_from(order + "I", blob, at + 2 + 12 * count)[0]


def unpacked(data: bytes, how: int, size: int) -> bytes:
    """size bytes of a strip or tile stored with compression how."""
    if how == PLAIN:
        raw = data[:size]
    elif how in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompressobj().decompress(data, size)
    elif how == LZW:
        raw = unlzw(data, size)
    elif how == PACKBITS:
        raw = unpackbits(data, size)
    else:
        raise ValueError(f"unknown compression {how}")
    if len(raw) != size:
        raise ValueError("strip or tile too short")
    return raw


def pixels(blob: bytes, d: dict, order: str) -> bytes:
    """Samples of one directory, row by row, pixel-interleaved: bytes for 1 and 8 bits, two little-endian bytes for 16."""
    import numpy as np

    one = lambda tag, other=None: d.get(tag, (other,))[0]
    width, height, samples, depths = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), set(d.get(DEPTH, (1,)))
    bits, how, predictor, apart = depths.pop(), one(COMPRESSION, PLAIN), one(PREDICTOR, 1), one(PLANAR, 1) == 2
    if not width or not height or depths or bits not in (1, 8, 16) or bits == 1 and samples != 1:
        raise ValueError("only 8- and 16-bit samples and bilevel images are read")
    if predictor not in (1, 2) or predictor == 2 and bits == 1:
        raise ValueError(f"unknown predictor {predictor}")
    if width * height * samples > 1 << 31:
        raise ValueError("image too large")
    tiled = TILE_WIDTH in d
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
    places, sizes = (d.get(TILE_AT), d.get(TILE_SIZE)) if tiled else (d.get(STRIP_AT), d.get(STRIP_SIZE))
    if not w or not h:
        raise ValueError("strips or tiles are missing")
    across, down = -(-width // w), -(-height // h)
    planes, inside = (samples, 1) if apart else (1, samples)
    if not places or not sizes or len(places) != len(sizes) or len(places) < across * down * planes:
        raise ValueError("strips or tiles are missing")
    kind = np.dtype(order + "u2") if bits == 16 else np.dtype(np.uint8)
    image = np.zeros((height, width, samples), "<u2" if bits == 16 else np.uint8)
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        top, left = cell // across * h, cell % across * w
        rows = h if tiled else min(h, height - top)
        line = -(-w // 8) if bits == 1 else w * inside * kind.itemsize
        raw = unpacked(blob[places[k] : places[k] + sizes[k]], how, rows * line)
        if bits == 1:
            part = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, :w].reshape(rows, w, 1)
        else:
            part = np.frombuffer(raw, kind).reshape(rows, w, inside)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        part = part[: height - top, : width - left]
        image[top : top + part.shape[0], left : left + part.shape[1], plane : plane + inside] = part
    return image.tobytes()


def stored_bytes(payload: bytes, width: int = 64) -> bytes:
    """A TIFF file that holds payload (a multiple of width) as one grey page.

    The form follows from a hash of the payload, so equal bytes give equal files, and every form meets payloads of
    every size: LZW, PackBits, or deflate with the horizontal predictor, each in strips of 64 KiB or in tiles 64 wide and up to 1024 high."""
    pick = zlib.crc32(payload)
    how, tiled = (LZW, PACKBITS, DEFLATE, DEFLATE)[pick % 4], pick // 4 % 4 == 0
    height = len(payload) // width
    rows = min(-(-height // 16) * 16 if tiled else height, 1024)  # tiles are multiples of 16 high
    parts = []
    for at in range(0, len(payload), rows * width):
        raw = payload[at : at + rows * width]
        if tiled:
            raw = raw.ljust(rows * width, b"\0")
        parts.append(lzw(raw) if how == LZW else packbits(raw) if how == PACKBITS else zlib.compress(differences(raw, width), 6))
    body, places, at = bytearray(), [], 8
    for x in parts:
        places.append(at)
        body += x + b"\0" * (len(x) % 2)
        at += len(x) + len(x) % 2
    grid = [(TILE_WIDTH, 4, [width]), (TILE_HEIGHT, 4, [rows]), (TILE_AT, 4, places), (TILE_SIZE, 4, [*map(len, parts)])] if tiled else [(STRIP_AT, 4, places), (ROWS, 4, [rows]), (STRIP_SIZE, 4, [*map(len, parts)])]
    fields = sorted([(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (DEPTH, 3, [8]), (COMPRESSION, 3, [how]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [2 if how == DEFLATE else 1]), *grid])
    extra, entries, free = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        data = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(data) > 4:
            data, extra = struct.pack("<I", free + len(extra)), extra + data
        entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + bytes(body) + struct.pack("<H", len(fields)) + entries + b"\0" * 4 + extra


def pages(blob: bytes | None):
    """(page, directory, pixels, error) of each page of a file; an error of the walk ends it with page and directory None."""
    page = 0
    try:
        if blob is None:
            raise ValueError("no content")
        order = "<" if blob[:1] == b"I" else ">"
        for page, d in enumerate(directories(blob)):
            try:
                yield page, d, pixels(blob, d, order), None
            except (ValueError, TypeError, IndexError, struct.error, zlib.error, MemoryError) as e:
                yield page, d, None, str(e) or "damaged"
    except (ValueError, struct.error) as e:
        yield None, {}, None, str(e) or "damaged"


def decoded(files: DataFrame, key: str, content: str) -> DataFrame:
    """One row per page: key, page, width, height, samples, compression, predictor, pixels, error."""
    small_batches(files.sparkSession, 200)
    kind = files.schema[key].dataType.simpleString()
    names = [key, "page", "width", "height", "samples", "compression", "predictor", "pixels", "error"]
    tags = ((WIDTH, None), (HEIGHT, None), (SAMPLES, 1), (COMPRESSION, PLAIN), (PREDICTOR, 1))

    def number(d: dict, tag: int, other):
        value = d.get(tag, (other,))[:1] or (None,)
        return value[0] if isinstance(value[0], int) and value[0] < 1 << 31 else None

    def run(batches):
        import pyarrow as pa

        for b in groups_of_text(batches, 1):
            rows = []
            for k, blob in enumerate(b.column(1).to_pylist()):
                for page, d, data, error in pages(blob):
                    rows.append((k, page, *(number(d, t, other) if page is not None else None for t, other in tags), data, error))
            cols = [*zip(*rows)] or [()] * 9
            types = [pa.int32()] * 6 + [pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(x, t) for x, t in zip(cols[1:], types))], names)

    return files.select(key, content).mapInArrow(run, f"{key} {kind}, page int, width int, height int, samples int, compression int, predictor int, pixels binary, error string")


def imaged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a TIFF file."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in groups_of_text(batches, 1):
            raw = [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            media = [stored_bytes(x + b"\0" * (-len(x) % 64 or 64 * (not x))) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([*map(len, raw)], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def op6_tiff(spark, sf_dir: str) -> DataFrame:
    """Texts through the writer and back through the page decoder; both halves stay in one stage."""
    media = imaged(table(spark, sf_dir, "documents"))
    kept = media.select(F.struct("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("doc"), "media")
    pages = decoded(kept, "doc", "media")
    px = F.col("pixels")
    size = F.length(px).cast("long")
    feature = F.format_string("%dx%dx%d c%d p%d", "width", "height", "samples", "compression", "predictor")
    return pages.select(
        "doc.doc_id", "doc.n_bytes", size.alias("payload_bytes"), F.sha2(px, 256).alias("payload_sha256"),
        F.crc32(F.substring(px, -64, 64)).alias("tail_crc32"), "doc.media_bytes", "doc.media_sha256",
        F.concat_ws(" ", feature, F.hex(F.crc32(px))).alias("feature"), "page", "error")
