"""TIFF columns: image files to rows, one for each page."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sugarbeam.llm.util import in_batches, trimmed

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


class BadTiff(ValueError):
    """The bytes are not a TIFF file that this reader can decode."""


def unpackbits(raw: bytes, most: int) -> bytes:
    out, i, n = bytearray(), 0, len(raw)
    while i < n and len(out) < most:
        c = raw[i]
        if c < 128:
            out += raw[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += raw[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out[:most])


def packbits(raw: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(raw)
    while i < n:
        run = 1
        while run < 128 and i + run < n and raw[i + run] == raw[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, raw[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 2 < n and raw[j] == raw[j + 1] == raw[j + 2]):
            j += 1
        out += bytes((j - i - 1,)) + raw[i:j]
        i = j
    return bytes(out)


def unlzw(raw: bytes, most: int) -> bytes:
    """TIFF's variety: most significant bit first, and codes grow by a bit one code early."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last = list(first), 9, b""
    out, bits, have = bytearray(), 0, 0
    for byte in raw:
        bits = bits << 8 | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise BadTiff("LZW code out of range")
        out += word
        if last:
            table.append(last + word[:1])
            width = min(12, max(9, (len(table) + 1).bit_length()))
        last = word
        if len(out) >= most:
            break
    return bytes(out[:most])


def lzw(raw: bytes) -> bytes:
    first = {bytes((i,)): i for i in range(256)}
    bits, have, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have)
            bits &= (1 << have) - 1

    table, size, width, word = dict(first), 258, 9, b""
    put(256, 9)
    for i in range(len(raw)):
        longer = word + raw[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = size
        size += 1
        if size == 4094:
            put(256, 12)
            table, size, width = dict(first), 258, 9
        else:
            width = max(9, size.bit_length())
        word = raw[i : i + 1]
    if word:
        put(table[word], width)
        size += 1
        width = min(12, max(9, size.bit_length()))
    put(257, width)
    if have:
        out.append(bits << 8 - have & 255)
    return bytes(out)


def _unpack(kind: int, raw: bytes, most: int) -> bytes:
    if kind == NONE:
        return raw[:most]
    if kind in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(raw, most) if most else b""
        except zlib.error as e:
            raise BadTiff(f"deflate: {e}") from None
    if kind == PACKBITS:
        return unpackbits(raw, most)
    if kind == LZW:
        return unlzw(raw, most)
    raise BadTiff(f"compression {kind}")


def directories(raw: bytes) -> tuple[str, list[dict[int, list]]]:
    """(byte order, tags of each image directory). A chain that loops ends where it loops."""
    if raw[:4] not in (b"II*\0", b"MM\0*"):
        raise BadTiff("no TIFF header")
    e = "<" if raw[:2] == b"II" else ">"
    try:
        (at,), out, seen = struct.unpack_from(e + "I", raw, 4), [], set()
        while at and at not in seen:
            seen.add(at)
            (n,) = struct.unpack_from(e + "H", raw, at)
            tags: dict[int, list] = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(e + "HHI", raw, at + 2 + 12 * k)
                size = _SIZES.get(kind, 1) * count
                where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(e + "I", raw, at + 10 + 12 * k)[0]
                if where + size > len(raw):
                    raise BadTiff(f"tag {tag} lies beyond the file")
                if kind in _CODES:
                    tags[tag] = list(struct.unpack_from(f"{e}{count}{_CODES[kind]}", raw, where))
            out.append(tags)
            (at,) = struct.unpack_from(e + "I", raw, at + 2 + 12 * n)
    except struct.error:
        raise BadTiff("a directory lies beyond the file") from None
    return e, out


def page_array(raw: bytes, e: str, tags: dict[int, list]) -> np.ndarray:
    """Samples of a page as rows x columns x samples, of 8 or 16 bits."""
    def one(tag: int, default: int | None = None) -> int:
        v = tags.get(tag) or ([default] if default is not None else [])
        if not v:
            raise BadTiff(f"tag {tag} is missing")
        return v[0]

    width, height, kind, n = one(256), one(257), one(259, 1), one(277, 1)
    bits = tags.get(258) or [1]
    planar, predictor = one(284, 1), one(317, 1)
    if any(b != bits[0] for b in bits) or bits[0] not in (8, 16) or predictor not in (1, 2) or not n or not width:
        raise BadTiff(f"{bits} bits, predictor {predictor}, {n} samples, width {width}")
    tiled = 324 in tags
    starts, sizes = tags.get(324 if tiled else 273, []), tags.get(325 if tiled else 279, [])
    tw, th = (one(322), one(323)) if tiled else (width, min(one(278, height), height) or 1)
    if not tw or not th:
        raise BadTiff("empty tiles")
    across, down = math.ceil(width / tw), math.ceil(height / th)
    planes, per = (n, 1) if planar == 2 else (1, n)
    if len(starts) < planes * across * down or len(sizes) < planes * across * down:
        raise BadTiff("strips or tiles are missing")
    kind_of = np.dtype(f"{e}u{bits[0] // 8}")
    if width * height * n * kind_of.itemsize > 4096 * max(len(raw), 1):
        raise BadTiff("the page is larger than its data can hold")
    out = np.zeros((height, width, n), kind_of.newbyteorder("="))
    for p in range(planes):
        for k in range(across * down):
            y, x = k // across * th, k % across * tw
            rows = th if tiled else min(th, height - y)
            most = rows * tw * per * kind_of.itemsize
            a = starts[p * across * down + k]
            part = _unpack(kind, raw[a : a + sizes[p * across * down + k]], most)
            if len(part) < most:
                raise BadTiff("a strip or tile is short")
            block = np.frombuffer(part, kind_of).reshape(rows, tw, per).astype(out.dtype)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=out.dtype)
            h, w = min(rows, height - y), min(tw, width - x)
            out[y : y + h, x : x + w, p * per : (p + 1) * per] = block[:h, :w]
    return out


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: int = 0, rows: int = 128, order: str = "<", level: int = 1) -> bytes:
    """A TIFF file of 8-bit pages (rows x columns or rows x columns x samples), in strips, or in tiles of `tile` (a multiple of 16)."""
    pack = {NONE: bytes, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, level), PACKBITS: packbits}[compression]
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4
    for page in pages:
        a = page[:, :, None] if page.ndim == 2 else page
        height, width, n = a.shape
        th, tw = (tile, tile) if tile else (max(1, min(rows, height)), width)
        starts, sizes = [], []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                b = a[y : y + th, x : x + tw]
                if tile:
                    b = np.pad(b, ((0, th - b.shape[0]), (0, tw - b.shape[1]), (0, 0)))
                if predictor == 2:
                    b = np.diff(b, axis=1, prepend=np.zeros((b.shape[0], 1, n), np.uint8))
                got = pack(np.ascontiguousarray(b).tobytes())
                starts.append(len(out))
                sizes.append(len(got))
                out += got
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8] * n), (259, 3, [compression]), (262, 3, [2 if n >= 3 else 1]), (277, 3, [n]), (284, 3, [1]), (317, 3, [predictor])]
        tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, starts), (325, 4, sizes)] if tile else [(273, 4, starts), (278, 4, [th]), (279, 4, sizes)]
        body = bytearray(struct.pack(order + "H", len(tags)))
        out += b"\0" * (len(out) % 2)

        for tag, kind, v in sorted(tags):
            data = struct.pack(f"{order}{len(v)}{_CODES[kind]}", *v)
            body += struct.pack(order + "HHI", tag, kind, len(v))
            if len(data) <= 4:
                body += data.ljust(4, b"\0")
            else:
                body += struct.pack(order + "I", len(out))
                out += data + b"\0" * (len(data) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + len(body)
        out += body + b"\0\0\0\0"

    return bytes(out)


PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, feature string, error string"


def feature(a: np.ndarray) -> str:
    """Size, mean, spread and entropy of the samples, at a fixed number of digits."""
    flat = np.ascontiguousarray(a).view(np.uint8).ravel()
    n = np.bincount(flat, minlength=256)
    p = n[n > 0] / max(len(flat), 1)
    mean = float((n * np.arange(256)).sum()) / max(len(flat), 1)
    var = float((n * (np.arange(256) - mean) ** 2).sum()) / max(len(flat), 1)
    return f"{a.shape[1]}x{a.shape[0]}x{a.shape[2]};mean={mean:.4f};sd={math.sqrt(var):.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f};levels={len(p)}"


def pages_of(raw: bytes | None) -> list[tuple]:
    """The PAGE rows of a file. What cannot be decoded gives a row with `error`; a null or empty file gives one, too."""
    if not raw:
        return [(None,) * 9 + ("no bytes",)]
    try:
        e, found = directories(raw)
    except BadTiff as bad:
        return [(None,) * 9 + (str(bad),)]
    out: list[tuple] = []
    for k, tags in enumerate(found):
        try:
            a = page_array(raw, e, tags)
            out.append((k, a.shape[1], a.shape[0], a.shape[2], 8 * a.dtype.itemsize, (tags.get(259) or [1])[0], (tags.get(317) or [1])[0], np.ascontiguousarray(a).tobytes(), feature(a), None))
        except BadTiff as bad:
            out.append((k,) + (None,) * 8 + (str(bad),))
    return out or [(None,) * 9 + ("no directory",)]


def pages(files: DataFrame, column: str, keep: list[tuple[str, str]]) -> DataFrame:
    """The columns `keep` (name, type) of files and PAGE for each page of the TIFF file in `column`.

    Byte order, strips or tiles, chunky or planar samples of 8 or 16 bits, predictors 1 and 2 and no, PackBits,
    LZW or deflate compression are understood. Every file gives at least one row. Files are decoded one at a time,
    so a worker holds one file and its pages; equal files and repeated rows give equal rows.
    """
    names = [k for k, _ in keep]
    types = [pa.int32()] * 7 + [pa.large_binary(), pa.string(), pa.string()]
    fields = ["page", "width", "height", "samples", "bits", "compression", "predictor", "pixels", "feature", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types[7] = pa.binary()

        def send(at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in names), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(types))], [*names, *fields])

        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            held = 0
            for i in range(batch.num_rows):
                for r in pages_of(batch.column(column)[i].as_py()):
                    at.append(i)
                    rows.append(r)
                    held += len(r[7] or b"")
                    if held > 4 << 20:
                        yield send(at, rows)
                        at, rows, held = [], [], 0
            if rows:
                yield send(at, rows)

    return files.select(*dict.fromkeys([*names, column])).transform(in_batches).mapInArrow(trimmed(run), ", ".join([*(f"`{n}` {t}" for n, t in keep), PAGE]))


def store_texts(docs: DataFrame, width: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes (null: none), filled with 0 to a positive multiple of
    `width`, as rows of `width` 8-bit samples of a page with deflate strips and the horizontal predictor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files, held, i0 = [], [], 0, 0
            text = batch.column("text").cast(pa.binary())
            for i in range(batch.num_rows):
                raw = text[i].as_py() or b""
                a = np.zeros(max(1, -(-len(raw) // width)) * width, np.uint8)
                a[: len(raw)] = np.frombuffer(raw, np.uint8)
                sizes.append(len(raw))
                files.append(encode([a.reshape(-1, width)]))
                held += len(files[-1])
                if held > 4 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i0, len(sizes)), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])
                    sizes, files, held, i0 = [], [], 0, i + 1

    return docs.select("doc_id", "text").transform(in_batches).mapInArrow(trimmed(run), "doc_id bigint, n_bytes bigint, media binary")
