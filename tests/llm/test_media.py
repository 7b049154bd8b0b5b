import hashlib
import struct
import zlib

import numpy as np
import pytest

from lodestar.llm import jpeg_media as jm

# --- a plain encoder, bit by bit, for images with several components


# fixed values: the luminance tables that the standard gives as an example
STANDARD_DC = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))
STANDARD_AC = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]) + bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"
    "090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
    "838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9da"
    "e1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)


def encode(width, height, parts, blocks, every=0, tables=(STANDARD_DC, jm.AC_RUNS), apart=False):
    """parts: (h, v) of each component; blocks: {component: (down, across, 64) quantised coefficients}; apart: a scan for each component."""
    seg = jm._segment
    big_h, big_v = max(h for h, _ in parts), max(v for _, v in parts)
    frame = struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, min(i, 1)]) for i, (h, v) in enumerate(parts))
    quant = b"\0" + bytes([8] * 64) + b"\1" + bytes([3] * 64)
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, quant) + seg(0xC0, frame) + seg(0xC4, b"\0" + tables[0] + b"\x10" + tables[1])
    head += seg(0xDD, struct.pack(">H", every)) if every else b""
    for own in [[c] for c in range(len(parts))] if apart else [list(range(len(parts)))]:
        if len(own) == 1:
            h, v = parts[own[0]]
            across, down = -(-(-(-width * h // big_h)) // 8), -(-(-(-height * v // big_v)) // 8)
            shape = {own[0]: (1, 1)}
        else:
            across, down, shape = -(-width // (8 * big_h)), -(-height // (8 * big_v)), dict(enumerate(parts))
        head += seg(0xDA, bytes([len(own)]) + b"".join(bytes([i + 1, 0]) for i in own) + b"\0\x3f\0") + scan_of(across, down, shape, blocks, every, tables)
    return head + b"\xff\xd9"


def scan_of(across, down, shape, blocks, every, tables):
    dc, ac = (jm.canonical(list(t[:16]), t[16:]) for t in tables)
    out, bits, last, n = bytearray(), "", dict.fromkeys(shape, 0), 0

    def number(v, size):
        return format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for i in range(0, len(bits), 8):
            out.append(int(bits[i : i + 8], 2))
            if out[-1] == 0xFF:
                out.append(0)
        bits = ""

    for y in range(down):
        for x in range(across):
            if every and n and n % every == 0:
                flush()
                out.extend([0xFF, 0xD0 + (n // every - 1) % 8])
                last = dict.fromkeys(shape, 0)
            n += 1
            for c, (h, v) in shape.items():
                for j in range(v):
                    for i in range(h):
                        b = blocks[c][y * v + j][x * h + i].tolist()
                        d, last[c] = b[0] - last[c], b[0]
                        size = abs(d).bit_length()
                        bits += format(dc[size][0], f"0{dc[size][1]}b") + number(d, size)
                        run = 0
                        for a in b[1:]:
                            if not a:
                                run += 1
                                continue
                            while run > 15:
                                bits += format(ac[0xF0][0], f"0{ac[0xF0][1]}b")
                                run -= 16
                            size = abs(a).bit_length()
                            code, length = ac[run << 4 | size]
                            bits += format(code, f"0{length}b") + number(a, size)
                            run = 0
                        if run:
                            bits += format(ac[0][0], f"0{ac[0][1]}b")
    flush()
    return bytes(out)


@pytest.mark.parametrize("every", [0, 1, 3])
@pytest.mark.parametrize("parts", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1), (1, 1), (1, 1)]])
def test_images_of_others(parts, every):
    rng = np.random.default_rng(len(parts) * 10 + every)
    width, height = 45, 37
    big_h, big_v = max(h for h, _ in parts), max(v for _, v in parts)
    across, down = -(-width // (8 * big_h)), -(-height // (8 * big_v))
    blocks = {c: rng.integers(-90, 90, (down * v, across * h, 64)) * (rng.random((down * v, across * h, 64)) < 0.2) for c, (h, v) in enumerate(parts)}
    (im,) = jm.decode_images([encode(width, height, parts, blocks, every)])
    assert (im.status, im.width, im.height) == ("ok", width, height)
    want = np.clip((blocks[0][:, :, 0] * 8 + 4) // 8 + 128, 0, 255)[: -(-height // 8), : -(-width // 8)]
    assert (im.thumbnail == want).all()
    order = [blocks[c][y * v + j][x * h + i] for y in range(down) for x in range(across) for c, (h, v) in enumerate(parts) for j in range(v) for i in range(h)]
    assert (im.coefficients == np.array(order)).all()


@pytest.mark.parametrize("every", [0, 2])
@pytest.mark.parametrize("parts", [[(2, 2), (1, 1), (1, 1)], [(1, 1), (1, 1), (1, 1)], [(1, 2), (1, 1)]])
def test_a_scan_for_each_component_and_standard_tables(parts, every):
    rng = np.random.default_rng(len(parts) + every)
    width, height = 45, 37
    big_h, big_v = max(h for h, _ in parts), max(v for _, v in parts)
    across, down = -(-width // (8 * big_h)), -(-height // (8 * big_v))
    blocks = {c: rng.integers(-90, 90, (down * v, across * h, 64)) * (rng.random((down * v, across * h, 64)) < 0.2) for c, (h, v) in enumerate(parts)}
    data = encode(width, height, parts, blocks, every, (STANDARD_DC, STANDARD_AC), apart=True)
    together = encode(width, height, parts, blocks, every, (STANDARD_DC, STANDARD_AC))
    one, two, cut = jm.decode_images([data, together, data[: data.index(b"\xff\xda")] + b"\xff\xd9"])
    assert one.status == two.status == "ok" and cut.status == "corrupt"
    assert (one.thumbnail == two.thumbnail).all() and one.thumbnail.shape == (5, 6)
    want = [blocks[c][y][x] for c, (h, v) in enumerate(parts) for y in range(-(-(-(-height * v // big_v)) // 8)) for x in range(-(-(-(-width * h // big_h)) // 8))]
    assert (one.coefficients == np.array(want)).all()


def test_flat_grey():
    (im,) = jm.decode_images([encode(16, 8, [(1, 1)], {0: np.zeros((1, 2, 64), int)})])
    assert im.thumbnail.tolist() == [[128, 128]] and jm.average_hash(im.thumbnail) == "0" * 16


@pytest.mark.parametrize("payload", [bytes(64), bytes([128]) * 64, bytes(range(256)) * 3, bytes([255] * 640), bytes([128] * 63 + [1]) * 20, bytes([128] * 6400), bytes(63) + b"a" + bytes(10) + b"b" * 54, (bytes(40) + b"a" * 24) * 9])
def test_payload_round_trip(payload):
    data = jm.carrier(payload)
    (im,) = jm.decode_images([data])
    assert im.status == "ok" and jm.payload_of(im) == payload and data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"


def test_random_payloads_side_by_side():
    rng = np.random.default_rng(2)
    payloads = [bytes(rng.choice(rng.integers(0, 256, 9), 64 * n).astype(np.uint8)) for n in rng.integers(1, 90, 60)]
    assert [jm.payload_of(i) for i in jm.decode_images([jm.carrier(p) for p in payloads])] == payloads


def test_bad_media():
    good = jm.carrier(bytes(range(64)) * 40)
    cut, progressive = good[: len(good) // 2], good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    got = jm.decode_images([None, b"", b"GIF89a", good[:30], cut, progressive, good])
    assert [i.status for i in got] == ["empty", "empty", "unsupported", "corrupt", "corrupt", "unsupported", "ok"]


def test_thumbnail_hash_follows_the_picture():
    a = np.zeros((20, 30), np.uint8)
    a[:, 15:] = 200
    assert jm.average_hash(a) == jm.average_hash(np.minimum(a + 3, 255)) != jm.average_hash(a[:, ::-1])
    assert len(jm.average_hash(np.array([[7]], np.uint8))) == 16


def test_query_against_python(small, edge, none):
    for docs in (small, edge):
        got = sorted(map(tuple, jm.digest(jm.encode_texts(docs)).drop("feature", "media_bytes", "media_sha256").collect()), key=str)
        want = []
        for d, t in docs.select("doc_id", "text").collect():
            raw = (t or "").encode()
            p = raw + bytes(-len(raw) % 64 if raw else 64)
            want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        assert got == sorted(want, key=str)
        assert sorted(map(tuple, jm.stored_digest(docs).collect()), key=str) == sorted(map(tuple, jm.digest(jm.encode_texts(docs)).collect()), key=str)
    assert jm.stored_digest(none).count() == 0


def test_media_columns(small):
    rows = jm.describe_media(jm.encode_texts(small)).collect()
    assert len(rows) == 200 and all(r["status"] == "ok" and len(r["thumbnail"]) == r["width"] * r["height"] // 64 for r in rows)
