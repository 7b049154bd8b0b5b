import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import packing, tokens


def first_fit_optimum(lengths, capacity):
    """The least number of bins, by trying all."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best and i < len(lengths):
            return
        if i == len(lengths):
            best = min(best, len(bins))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                place(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1 :])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_bound_optimum_and_packing(lengths):
    x = np.array(sorted(lengths, reverse=True))
    _, _, used = packing.best_fit_decreasing(x, 12)
    best = first_fit_optimum(x.tolist(), 12)
    assert packing.lower_bound(x, 12) <= best <= used


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_bins_are_gapless_and_tightest(lengths):
    x = np.array(lengths, dtype=np.int64)
    bins, offsets, used = packing.best_fit_decreasing(x, 50)
    space = {}
    for i in sorted(range(len(x)), key=lambda i: -x[i]):
        fits = [s for s in space.values() if s >= x[i]]
        before = space.get(bins[i], 50)
        assert offsets[i] == 50 - before and before == (min(fits) if fits else 50)
        space[bins[i]] = before - x[i]
    assert len(space) == used


def check(docs, out, vocabulary):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    want = sorted((d if d is not None else -1, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in docs)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    pieces = []
    for d, ids in want:
        n = len(ids)
        stops = list(range(n % 1024 or 1024, n + 1, 1024))
        for p, stop in enumerate(stops):
            start = stops[p - 1] if p else 0
            pieces.append((d, p, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(pieces)
    return len(by)


def test_round_trip_and_exchange(small):
    vocabulary = tokens.default_vocabulary()
    docs = [tuple(r) for r in small.select("doc_id", "text").collect()]
    whole = packing.pack_documents(small, vocabulary).collect()
    n = check(docs, whole, vocabulary)
    x = np.array([r["length"] for r in whole])
    assert packing.lower_bound(x, 1024) <= n <= packing.lower_bound(x, 1024) + 1
    parts = packing.pack(packing.pieces(small, vocabulary), per_partition=40).collect()
    assert n <= check(docs, parts, vocabulary)
    once = packing.pack(packing.pieces(small, vocabulary), per_partition=40, max_rounds=1).collect()
    assert check(docs, parts, vocabulary) <= check(docs, once, vocabulary)


def test_edges(edge, none):
    vocabulary = tokens.default_vocabulary()
    check([tuple(r) for r in edge.select("doc_id", "text").collect()], packing.pack_documents(edge, vocabulary).collect(), vocabulary)
    out = packing.pack_documents(none, vocabulary)
    assert out.count() == 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_ids_can_be_kept(small):
    vocabulary = tokens.default_vocabulary()
    for r in packing.pack(packing.pieces(small, vocabulary, with_ids=True)).limit(20).collect():
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]


def test_encoding_by_pieces_is_encoding():
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    texts = ["a b  c\n\n d\t\te \x1c f", "<|endoftext|>x", "  ", "\n\n a", " a　b \xa0 c", "it's don't 'll x'ree", "a\r\nb", "\x85 q", None, "", " ", "²x½ Ⅷ一二 _a_b__ x_1", "१२3 x٣", "éÀ̃ x", "😀😀 ok", "x" * 5000]
    tok = Tokenizer.from_file(path)
    want = [np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokens.encode(texts, path) == want and tokens.encode(texts[::-1], path) == want[::-1]


def test_ids_are_the_librarys_for_every_character():
    """All assigned planes and the tags, also characters that Python's tables don't have."""
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    whole = Tokenizer.from_file(path)
    for lo in [*range(0, 0x33000, 4096), 0xE0000]:
        texts = [f"a{c}b {c}1 {c}{c} x\n{c}" for c in (chr(x) for x in range(lo, lo + 4096) if not 0xD800 <= x < 0xE000)]
        want = [np.asarray(e.ids, "<u4").tobytes() for e in whole.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        assert tokens.encode(texts, path) == want
