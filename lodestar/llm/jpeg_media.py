"""Media columns: baseline JPEG, read with numpy alone.

`decode_images` parses markers, Huffman-decodes the scan of many images side by side and reconstructs luminance
thumbnails of one pixel per 8x8 block from the DC coefficients. A lane is the data between two restart markers; all
lanes take a symbol per step, so a step is a few numpy calls for thousands of blocks.

`carrier` stores bytes without loss: 64 bytes are the quantised coefficients of a block, in zigzag order. A table gives
each byte its coefficient, near zero for frequent ones, zero for zero. Quantisers are 1. Blocks fill an image about as wide as high; a comment gives the number of payload bytes.

Components may stand in one scan or in several; the thumbnail comes from the scan that has the first one.

Defined results: what is no baseline JPEG of 8 bits (progressive, arithmetic, 12 bits) has status "unsupported", damaged data or
a first component without a scan "corrupt", null or empty media "empty"; dimensions, thumbnail and hash are then null as far as
unknown. Null text is empty; its payload is one block of zero bytes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import cut, remove, stored

RESTART = 8  #: blocks between restart markers in images written here
CHUNK_BYTES = 2_000_000  #: compressed bytes decoded side by side


# --- Huffman tables


def canonical(counts: list[int], symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of the table in a DHT segment."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at, code = at + n, code << 1
    return out


@lru_cache(maxsize=256)
def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: length of the code | symbol << 8; 0 if no code fits. table: body of a DHT segment's table."""
    out = np.zeros(1 << 16, np.int32)
    for s, (code, length) in canonical(list(table[:16]), table[16:]).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = length | s << 8
    return out


def _table(by_length: dict[int, list[int]]) -> bytes:
    return bytes(len(by_length.get(n, ())) for n in range(1, 17)) + bytes(x for n in sorted(by_length) for x in by_length[n])


# Static tables for coefficients of -127 to 128. Frequent bytes have small coefficients, so sizes 1 to 3 have two bits. Zeros only
# fill up blocks, unless a text has zero bytes; then all runs have codes, too.
DC_TABLE = _table({4: list(range(9))})
AC_TABLE = _table({2: [1, 2, 3], 3: [4], 5: [0x00, 5, 6], 6: [7], 7: [8]})
AC_RUNS = _table({2: [1, 2, 3], 3: [4], 5: [0x00], 6: [5, 6], 7: [7], 8: [8, 0xF0], 12: [r << 4 | s for r in range(1, 16) for s in range(1, 9)]})


# --- bytes as coefficients

_FREQUENT = b" etaoinsrhldcumfpgwybvk,.-\nETAOINSRHLDCUM'jxqz\xc3"


def _coefficients() -> np.ndarray:
    """The coefficient of each byte: 0 for zero, then 1, -1, 2, -2 and so on, for frequent bytes of texts first."""
    order = [0, *_FREQUENT, *(b for b in range(1, 256) if b not in _FREQUENT)]
    out = np.zeros(256, np.int16)
    out[order] = [(r + 1) // 2 if r % 2 else -(r // 2) for r in range(256)]
    return out


COEFFICIENT = _coefficients()
BYTE = np.zeros(256, np.uint8)
BYTE[COEFFICIENT + 127] = np.arange(256)


# --- writing


@lru_cache(maxsize=8)
def _arrays(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, (c, n) in canonical(list(table[:16]), table[16:]).items():
        code[s], length[s] = c, n
    return code, length


_DC = _arrays(DC_TABLE)
_SIZE = np.array([abs(v).bit_length() for v in range(-2048, 2048)], dtype=np.int64)


def _scan(blocks: np.ndarray, ac_table: bytes) -> bytes:
    """Entropy-coded data of blocks (n, 64) in zigzag order, with restart markers."""
    n, codes = len(blocks), _arrays(ac_table)
    dc = blocks[:, 0].astype(np.int64)
    diff = np.diff(dc, prepend=0)
    diff[::RESTART] = dc[::RESTART]
    ac = blocks[:, 1:].astype(np.int64)
    there = ac != 0
    at = np.where(there, np.arange(63), -1)
    before = np.maximum.accumulate(np.concatenate([np.full((n, 1), -1), at[:, :-1]], axis=1), axis=1)
    run = np.where(there, np.arange(63) - before - 1, 0)

    def item(symbol, value, size, tables, on=None):
        extra = np.where(value < 0, value + (1 << size) - 1, value).astype(np.uint64)
        bits = (tables[0][symbol] << size.astype(np.uint64)) | extra
        length = tables[1][symbol] + size
        return (bits, length) if on is None else (np.where(on, bits, 0), np.where(on, length, 0))

    size_dc, size_ac = _SIZE[diff + 2048], _SIZE[ac + 2048]
    d_bits, d_len = item(size_dc, diff, size_dc, _DC)
    a_bits, a_len = item((run & 15) << 4 | size_ac, ac, size_ac, codes, there)
    end = ~there[:, 62]
    e_bits, e_len = np.where(end, codes[0][0], 0).astype(np.uint64), np.where(end, codes[1][0], 0)
    if (run > 15).any():  # up to three symbols for 16 zeros stand before the item
        z_bits, z_len = np.zeros_like(a_bits), np.zeros_like(a_len)
        for _ in range(3):
            more = run > 15
            z_bits = np.where(more, z_bits << np.uint64(codes[1][0xF0]) | codes[0][0xF0], z_bits)
            z_len, run = z_len + more * codes[1][0xF0], run - 16 * more
        a_bits, a_len = np.stack([z_bits, a_bits], 2).reshape(n, -1), np.stack([z_len, a_len], 2).reshape(n, -1)
    bits = np.concatenate([d_bits[:, None], a_bits, e_bits[:, None]], axis=1)
    length = np.concatenate([d_len[:, None], a_len, e_len[:, None]], axis=1)
    firsts = np.arange(0, n, RESTART)
    lasts = np.minimum(firsts + RESTART, n) - 1
    pad = -np.add.reduceat(length.sum(axis=1), firsts) % 8
    bits[lasts, -1] = bits[lasts, -1] << pad.astype(np.uint64) | ((1 << pad) - 1).astype(np.uint64)
    length[lasts, -1] += pad

    bits, length = bits.ravel(), length.ravel()
    some = length > 0
    bits, length = bits[some], length[some]
    stop = np.cumsum(length)
    start = stop - length
    word = start >> 5
    placed = bits << (64 - length - (start & 31)).astype(np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(int(stop[-1] + 31 >> 5) + 2, np.uint64)
    words[word[heads]] += np.add.reduceat(placed >> np.uint64(32), heads)
    words[word[heads] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), heads)
    data = words.astype(">u4").view(np.uint8)[: int(stop[-1]) // 8]

    per = np.zeros(n + 1, np.int64)
    per[1:] = np.cumsum(_row_bits(length, some, n))
    cuts = per[firsts[1:]] // 8
    stuffed = np.flatnonzero(data == 0xFF) + 1
    marks = np.stack([np.full(len(cuts), 0xFF), 0xD0 + np.arange(len(cuts)) % 8], 1).ravel()
    return np.insert(data, np.concatenate([stuffed, np.repeat(cuts, 2)]), np.concatenate([np.zeros(len(stuffed), np.int64), marks]).astype(np.uint8)).tobytes()


def _row_bits(length: np.ndarray, some: np.ndarray, n: int) -> np.ndarray:
    full = np.zeros(len(some), np.int64)
    full[some] = length
    return full.reshape(n, -1).sum(axis=1)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def carrier(payload: bytes) -> bytes:
    """A baseline JPEG of one component that holds payload, a positive multiple of 64 bytes."""
    n = len(payload) // 64
    wide = max(1, int(np.ceil(np.sqrt(n))))
    high = -(-n // wide)
    if not n or len(payload) % 64 or wide > 8191:
        raise ValueError("the payload must be 64 bytes or a multiple, up to what 65,535 pixels a side hold")
    blocks = np.zeros((wide * high, 64), np.int16)
    blocks[:n] = COEFFICIENT[np.frombuffer(payload, np.uint8)].reshape(n, 64)
    some = blocks[:, 1:] != 0
    ac_table = AC_RUNS if (some[:, 1:] & ~some[:, :-1]).any() else AC_TABLE  # a zero before another coefficient
    head = [
        b"\xff\xd8",
        _segment(0xFE, b"payload %d" % len(payload)),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + DC_TABLE + b"\x10" + ac_table),
        _segment(0xDD, struct.pack(">H", RESTART)),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ]
    return b"".join([*head, _scan(blocks, ac_table), b"\xff\xd9"])


# --- reading


@dataclass
class Scan:
    start: int
    stop: int
    every: int  #: MCUs between restart markers, 0 without
    parts: list[int]  #: which components
    pattern: tuple  #: blocks of an MCU: (component, DC table, AC table)
    steps: list[int]  #: each component's quantiser of the DC coefficient
    blocks: np.ndarray | None = None


@dataclass
class Image:
    status: str = "ok"
    width: int | None = None
    height: int | None = None
    comment: bytes = b""
    thumbnail: np.ndarray | None = None  #: uint8, a pixel for each block of the luminance component
    coefficients: np.ndarray | None = None  #: int16 (blocks in the order of scans, 64), quantised, zigzag
    _parts: list = field(default_factory=list)  # components: (id, h, v, quantiser table)
    _quant: dict = field(default_factory=dict)
    _huff: dict = field(default_factory=dict)
    _scans: list = field(default_factory=list)


class _Unsupported(Exception):
    pass


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _parse(data: bytes) -> Image:
    """Header and scan boundaries."""
    im, at, every = Image(), 2, 0
    if data[:2] != b"\xff\xd8":
        raise _Unsupported
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if data[at] != 0xFF:
            raise ValueError("no marker")
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise ValueError("short segment")
        at += 2 + size
        if kind == 0xFE:
            im.comment = body
        elif kind == 0xDB:
            while body:
                k = 128 if body[0] >> 4 else 64
                im._quant[body[0] & 15] = np.frombuffer(body[1 : 1 + k], ">u2" if k == 128 else np.uint8).astype(np.int64)
                body = body[1 + k :]
        elif kind == 0xC4:
            while body:
                k = 17 + sum(body[1:17])
                im._huff[body[0]] = body[1:k]
                body = body[k:]
        elif kind == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif kind in (0xC0, 0xC1):
            bits, im.height, im.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not im.height or not im.width:
                raise _Unsupported
            im._parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise _Unsupported
        elif kind == 0xDA:
            if not im._parts:
                raise _Unsupported
            found = _SCAN_END.search(data, at)
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            parts = [i for i, p in enumerate(im._parts) if p[0] in tables]
            pattern = []
            for i in parts:
                ident, h, v, _ = im._parts[i]
                pattern += [(i, im._huff[tables[ident] >> 4], im._huff[0x10 | tables[ident] & 15])] * (1 if len(parts) == 1 else h * v)
            if not parts or any(i in s.parts for s in im._scans for i in parts):
                raise ValueError("a scan of no component or of one that has been read")
            steps = [int(im._quant[im._parts[i][3]][0]) for i in parts]
            im._scans.append(Scan(at, found.start() if found else len(data), every, parts, tuple(pattern), steps))
            if not found:
                break
            at = found.start()
    if not any(0 in s.parts for s in im._scans):
        raise ValueError("no scan of the first component")
    return im


def _sides(im: Image, i: int) -> tuple[int, int]:
    """Blocks of component i across and down, without what fills up MCUs."""
    big_h, big_v = max(p[1] for p in im._parts), max(p[2] for p in im._parts)
    return -(-(-(-im.width * im._parts[i][1] // big_h)) // 8), -(-(-(-im.height * im._parts[i][2] // big_v)) // 8)


def _grid(im: Image, scan: Scan) -> tuple[int, int, int, int]:
    """MCUs across and down, blocks of the scan's first component across and down an MCU."""
    if len(scan.parts) == 1:
        return (*_sides(im, scan.parts[0]), 1, 1)
    big_h, big_v = max(p[1] for p in im._parts), max(p[2] for p in im._parts)
    _, h, v, _ = im._parts[scan.parts[0]]
    return -(-im.width // (8 * big_h)), -(-im.height // (8 * big_v)), h, v


def decode_images(media: list[bytes | None], thumbnails: bool = True) -> list[Image]:
    images, groups = [], {}
    for data in media:
        if not data:
            images.append(Image(status="empty"))
            continue
        try:
            im = _parse(data)
            for scan in im._scans:
                groups.setdefault(scan.pattern, []).append((im, scan, data))
        except _Unsupported:
            im = Image(status="unsupported")
        except (IndexError, KeyError, ValueError, struct.error):
            im = Image(status="corrupt")
        images.append(im)
    for pattern, members in groups.items():
        at = 0
        while at < len(members):
            end, size = at, 0
            while end < len(members) and (end == at or size < CHUNK_BYTES):
                size, end = size + members[end][1].stop - members[end][1].start, end + 1
            _decode(members[at:end], pattern)
            at = end
    for im in images:
        if im.status == "ok":
            im.coefficients = im._scans[0].blocks if len(im._scans) == 1 else np.concatenate([s.blocks for s in im._scans])
    if thumbnails:
        for im in images:
            if im.status == "ok":
                im.thumbnail = _thumbnail(im)
    return images


def _decode(members: list[tuple[Image, Scan, bytes]], pattern: tuple) -> None:
    """Coefficients of scans with the same tables and block order."""
    per_mcu = len(pattern)
    stream, begin, count, first, owner, total, offset = [], [], [], [], [], 0, 0
    places = {}
    for i, (im, scan, data) in enumerate(members):
        across, down, _, _ = _grid(im, scan)
        n = across * down
        raw = np.frombuffer(data, np.uint8)[scan.start : scan.stop]
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        follow = raw[ff + 1]
        marks = ff[(follow >= 0xD0) & (follow <= 0xD7)]
        gone = np.concatenate([ff[follow == 0] + 1, marks, marks + 1])
        keep = np.ones(len(raw), bool)
        keep[gone] = False
        plain = raw[keep]
        every = scan.every or n
        lanes = -(-n // every)
        if len(marks) != lanes - 1:
            im.status = "corrupt"
            continue
        starts = np.concatenate([[0], marks - np.searchsorted(np.sort(gone), marks)])
        mcus = np.full(lanes, every)
        mcus[-1] = n - every * (lanes - 1)
        begin.append((starts + offset) * 8)
        count.append(mcus * per_mcu)
        first.append((total + np.arange(lanes) * every) * per_mcu)
        owner.append(np.full(lanes, i))
        stream.append(plain)
        places[i] = (total * per_mcu, n * per_mcu, every * per_mcu)
        total, offset = total + n, offset + len(plain)
    if not stream:
        return
    data = np.concatenate([*stream, np.full(16, 0xFF, np.uint8)])
    ahead = np.zeros(len(data) - 8, np.uint64)
    for j in range(8):
        ahead |= data[j : j + len(ahead)].astype(np.uint64) << np.uint64(56 - 8 * j)
    kinds = list(dict.fromkeys(t for _, dc, ac in pattern for t in (("d", dc), ("a", ac))))
    tables = np.concatenate([lookup(t) for _, t in kinds])
    dc_base = np.array([kinds.index(("d", dc)) << 16 for _, dc, _ in pattern])
    ac_base = np.array([kinds.index(("a", ac)) << 16 for _, _, ac in pattern])
    out = np.zeros(total * per_mcu * 64, np.int16)
    pos, left, base, lane_owner = (np.concatenate(x).astype(np.int64) for x in (begin, count, first, owner))
    base *= 64
    k, turn = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    bad, limit = set(), (len(data) - 16) * 8
    one = np.uint64(1)
    while len(pos):
        window = ahead[np.minimum(pos >> 3, len(ahead) - 1)] << (pos & 7).astype(np.uint64)
        is_dc = k == 0
        table = np.where(is_dc, dc_base[turn], ac_base[turn]) if per_mcu > 1 else np.where(is_dc, dc_base[0], ac_base[0])
        entry = tables[table + (window >> np.uint64(48)).astype(np.int64)]
        length, symbol = entry & 255, entry >> 8
        size = np.where(is_dc, symbol, symbol & 15)
        extra = ((window << length.astype(np.uint64)) >> one >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
        pos = pos + length + size
        run = np.where(is_dc, 0, symbol >> 4)
        k = k + run
        wrong = (length == 0) | (size > 15) | (k > 63) & (size > 0) | (pos > limit)
        if wrong.any():
            bad.update(lane_owner[wrong].tolist())
            k = np.where(wrong, 63, k)
            value = np.where(wrong, 0, value)
        put = size > 0
        out[base[put] + k[put]] = value[put]
        k = np.where(put | is_dc, k + 1, np.where(run == 15, k + 1, 64))
        over = k >= 64
        if over.any():
            k = np.where(over, 0, k)
            base = base + 64 * over
            left = left - over
            if per_mcu > 1:
                turn = (turn + over) % per_mcu
            if bad:
                left = np.where(np.isin(lane_owner, list(bad)), 0, left)
            more = left > 0
            if not more.all():
                pos, k, base, left, turn, lane_owner = pos[more], k[more], base[more], left[more], turn[more], lane_owner[more]
    blocks = out.reshape(-1, 64)
    part = np.array([c for c, _, _ in pattern])
    for i, (im, scan, _) in enumerate(members):
        if im.status != "ok":
            continue
        if i in bad:
            im.status = "corrupt"
            continue
        at, n, every = places[i]
        own = blocks[at : at + n].copy()
        for c in scan.parts:
            mine = np.flatnonzero(np.tile(part == c, n // per_mcu))
            sums = np.cumsum(own[mine, 0].astype(np.int64))
            group = mine // every
            heads = np.flatnonzero(np.diff(group, prepend=-1))
            own[mine, 0] = sums - (sums[heads] - own[mine[heads], 0])[group]
        scan.blocks = own


def _thumbnail(im: Image) -> np.ndarray:
    scan = next(s for s in im._scans if 0 in s.parts)
    across, down, h, v = _grid(im, scan)
    mine = [i for i, (c, _, _) in enumerate(scan.pattern) if c == 0]
    dc = scan.blocks[:, 0].reshape(-1, len(scan.pattern))[:, mine].astype(np.int64) * scan.steps[scan.parts.index(0)]
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    wide, high = _sides(im, 0)
    return np.clip((grid[:high, :wide] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(thumbnail: np.ndarray, side: int = 8) -> str:
    """side x side cell means against their mean, as hex; small thumbnails are repeated to fill the cells."""
    for axis in (0, 1):
        n = thumbnail.shape[axis]
        if n < side:
            thumbnail = np.repeat(thumbnail, -(-side // n), axis=axis)
    cells = thumbnail.astype(np.int64)
    count = np.ones_like(cells)
    for axis in (0, 1):
        edges = np.arange(side) * thumbnail.shape[axis] // side
        cells, count = np.add.reduceat(cells, edges, axis=axis), np.add.reduceat(count, edges, axis=axis)
    bits = cells * count.sum() > cells.sum() * count  # above the mean of all
    return np.packbits(bits.ravel()).tobytes().hex()


# --- columns


def encode_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, n_bytes (of the UTF-8 text), media (its carrier, padded with zero bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                raw = [(x or "").encode() for x in part.column(1).to_pylist()]
                media = [carrier(x + bytes(-len(x) % 64 if x else 64)) for x in raw]
                yield pa.record_batch([part.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def payload_of(im: Image) -> bytes:
    size = int(im.comment.removeprefix(b"payload "))
    return BYTE[im.coefficients[: size // 64] + 127].tobytes()


def describe_media(rows: DataFrame) -> DataFrame:
    """rows (doc_id, media): doc_id, status, width, height, thumbnail (binary, row by row), thumbnail_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ims = decode_images(part.column(1).to_pylist())
                shown = [None if i.thumbnail is None else i.thumbnail.tobytes() for i in ims]
                hashes = [None if i.thumbnail is None else average_hash(i.thumbnail) for i in ims]
                yield pa.record_batch([part.column(0), pa.array([i.status for i in ims]), pa.array([i.width for i in ims], pa.int32()), pa.array([i.height for i in ims], pa.int32()), pa.array(shown, pa.binary()), pa.array(hashes, pa.string())], names=["doc_id", "status", "width", "height", "thumbnail", "thumbnail_hash"])

    return rows.select("doc_id", "media").mapInArrow(run, "doc_id long, status string, width int, height int, thumbnail binary, thumbnail_hash string")


def digest(rows: DataFrame) -> DataFrame:
    """rows of encode_texts, read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, out = b.slice(at, 512), []
                media = part.column(2).to_pylist()
                for data, im in zip(media, decode_images(media)):
                    payload, shown = payload_of(im), im.thumbnail
                    feature = f"{im.width}x{im.height}:{average_hash(shown)}:{zlib.crc32(shown.tobytes()):08x}"
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.record_batch([part.column(0), part.column(1), *map(pa.array, zip(*out), kinds)], names=names)

    return rows.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored_digest(docs: DataFrame) -> DataFrame:
    """digest of the carriers of docs (doc_id, text): the media column is written to the shared folder, read back and removed."""
    rows, place = stored(encode_texts(docs))
    found = cut(digest(rows))
    remove(docs.sparkSession, place)
    return found
