"""TIFF files laid out by hand: both byte orders, several pages, tile grids, planes, depths, predictors, damage."""
import struct
import zlib

import numpy as np
import pytest

from tabulon.llm import tiff

#: Fixed value: the LZW example of the format's specification, as codes.
CODES, PLAIN = [256, 7, 258, 8, 8, 258, 6, 6, 257], bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def bits(codes, width=9):
    text = "".join(f"{c:0{width}b}" for c in codes)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def build(pages, order="<"):
    """A file of pages, each a dict of tag: (type, values) and 'parts', the strips or tiles; directories come before their data."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    for k, page in enumerate(pages):
        parts, tags = page["parts"], {t: v for t, v in page.items() if t != "parts"}
        tiled = 322 in tags
        tags[324 if tiled else 273] = (4, [0] * len(parts))
        tags[325 if tiled else 279] = (4, [len(p) for p in parts])
        at, formats = len(out), {1: "B", 2: "s", 3: "H", 4: "I"}
        directory = 2 + 12 * len(tags) + 4
        extra_at, extra = at + directory, b""
        sizes = sum(len(v) * {1: 1, 3: 2, 4: 4}[t] for t, v in tags.values() if len(v) * {1: 1, 3: 2, 4: 4}[t] > 4)
        data_at = extra_at + sizes
        places = np.cumsum([0] + [len(p) for p in parts])[:-1] + data_at
        tags[324 if tiled else 273] = (4, [int(p) for p in places])
        entries = b""
        for tag in sorted(tags):
            kind, values = tags[tag]
            raw = struct.pack(f"{order}{len(values)}{formats[kind]}", *values)
            if len(raw) > 4:
                raw, extra = struct.pack(order + "I", extra_at + len(extra)), extra + raw
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        body = extra + b"".join(parts)
        after = 0 if k == len(pages) - 1 else at + directory + len(body)
        out += struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", after) + body
    return bytes(out)


def grey(image, how=1, depth=8, **more):
    h, w = image.shape[:2]
    n = image.shape[2] if image.ndim == 3 else 1
    return {256: (3, [w]), 257: (3, [h]), 258: (3, [depth] * n), 259: (3, [how]), 262: (3, [1 if n == 1 else 2]), 277: (3, [n]), 278: (3, [h])} | more


def read(blob):
    return [(page, data, error) for page, _, data, error in tiff.pages(blob)]


G = np.random.default_rng(4)


def test_lzw_example_of_the_format():
    assert tiff.lzw(PLAIN) == bits(CODES) and tiff.unlzw(bits(CODES), 9) == PLAIN


@pytest.mark.parametrize("order", "<>")
def test_pages_of_many_kinds(order):
    one, two = G.integers(0, 256, (7, 5), np.uint8), G.integers(0, 256, (9, 6, 3), np.uint8)
    wide = G.integers(0, 1 << 16, (8, 5), np.uint16)
    flat = G.integers(0, 2, (5, 11), np.uint8)
    rows = [one[i : i + 3] for i in range(0, 7, 3)]
    step = np.diff(two.astype(int), axis=1, prepend=0).astype(np.uint8)
    wide_step = np.diff(wide.astype(int), axis=1, prepend=0).astype(np.uint16).astype(order + "u2")
    pages = [
        grey(one, 32773) | {278: (3, [3]), "parts": [tiff.packbits(r.tobytes()) for r in rows]},
        grey(two, 8) | {317: (3, [2]), "parts": [zlib.compress(step.tobytes())]},
        grey(two, 5) | {284: (3, [2]), "parts": [tiff.lzw(two[:, :, c].tobytes()) for c in range(3)]},  # separate planes
        grey(wide, 32946, 16) | {317: (3, [2]), "parts": [zlib.compress(wide_step.tobytes())]},
        grey(flat, 1, 1) | {"parts": [np.packbits(flat, axis=1).tobytes()]},
    ]
    got = read(build(pages, order))
    assert [e for _, _, e in got] == [None] * 5 and [p for p, _, _ in got] == [0, 1, 2, 3, 4]
    assert [d for _, d, _ in got] == [one.tobytes(), two.tobytes(), two.tobytes(), wide.astype("<u2").tobytes(), flat.tobytes()]


@pytest.mark.parametrize("order", "<>")
def test_grid_of_tiles(order):
    image = G.integers(0, 256, (40, 50), np.uint8)
    tiles = []
    for top in range(0, 40, 16):
        for left in range(0, 50, 16):
            t = np.full((16, 16), 9, np.uint8)
            part = image[top : top + 16, left : left + 16]
            t[: part.shape[0], : part.shape[1]] = part
            tiles.append(zlib.compress(t.tobytes()))
    page = grey(image, 8) | {322: (3, [16]), 323: (3, [16]), "parts": tiles}
    del page[278]
    assert read(build([page], order)) == [(0, image.tobytes(), None)]


def test_damage_costs_one_page():
    image = G.integers(0, 256, (4, 4), np.uint8)
    good = grey(image) | {"parts": [image.tobytes()]}
    bad = [grey(image, 77) | {"parts": [b"x"]}, grey(image, 5) | {"parts": [b"\x80"]}, grey(image, 8) | {"parts": [b"no stream"]}, grey(image, 1, 4) | {"parts": [image.tobytes()]}, grey(image) | {317: (3, [3]), "parts": [image.tobytes()]}, grey(image) | {256: (3, [0]), "parts": [b""]}]
    got = read(build([good, *bad, good]))
    assert [p for p, _, _ in got] == list(range(8)) and [bool(e) for _, _, e in got] == [False, *[True] * 6, False]
    assert got[0][1] == got[7][1] == image.tobytes()
    whole = build([good, good])
    for cut in range(len(whole)):  # whatever is cut off, no exception and no wrong pixels
        for _, data, error in read(whole[:cut]):
            assert error or data == image.tobytes()
    loop = bytearray(build([good]))
    n = struct.unpack_from("<H", loop, 8)[0]
    struct.pack_into("<I", loop, 10 + 12 * n, 8)  # points back at itself
    assert [p for p, _, _ in read(bytes(loop))] == [0]


def test_forms_do_not_depend_on_size():
    seen: dict = {}
    for n in range(1, 400):
        payload = G.integers(97, 123, 64 * n, np.uint8).tobytes()
        blob = tiff.stored_bytes(payload)
        ((page, d, data, error),) = tiff.pages(blob)
        assert (page, data, error) == (0, payload, None) and blob == tiff.stored_bytes(payload)
        seen.setdefault((d[tiff.COMPRESSION][0], tiff.TILE_WIDTH in d), []).append(n)
    assert len(seen) == 6 and all(min(x) < 100 and max(x) > 300 for x in seen.values())
