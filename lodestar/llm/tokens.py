"""Token ids of whole texts, with the tokenizers library.

A byte-level BPE works on pieces (a word with the space before it, a run of digits, marks or white space) and never
across them, so the ids of a text are those of its pieces in turn. Each Python worker keeps the ids of pieces that it has
met, up to `CACHE_PIECES`; further ones are encoded each time they come. New pieces are encoded as one string, in
which line feeds stand before pieces without a space; the bytes of its tokens tell where each piece ends. Texts with
characters that Python's own classes sort in another way or don't know, or with the string of a special token, are encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
import zlib

import numpy as np

CACHE_PIECES = 500_000
LONGEST_PIECE = 64  #: characters; longer ones are not kept
# fixed: the pieces of this vocabulary's byte-level pre-tokenizer
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_SEPARATORS = "\x1c\x1d\x1e\x1f\x85"


def _is_odd_character(c: str) -> bool:
    """Sorted by Python in another way than by the library, or unknown to Python, which may know fewer characters."""
    return c in _SEPARATORS or c.isnumeric() and not c.isdecimal() and not c.isalpha() or unicodedata.category(c) == "Cn"


_ODD = np.fromiter(map(_is_odd_character, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)
_ODD_LOW = re.compile("[" + "".join(map(chr, np.flatnonzero(_ODD[:256]))) + "]")
_state: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _loaded(path: str) -> dict:
    if _state.get("path") != path:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        _state.update(path=path, tok=tok, cache={}, sizes=_token_bytes(tok), special=special)
    return _state


def _token_bytes(tok) -> np.ndarray:
    """For each id the bytes that it stands for; a byte-level vocabulary has a character for each byte."""
    vocabulary = tok.get_vocab()
    sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        sizes[i] = len(token)
    return sizes


def _encode_new(pieces: list[str], s: dict) -> dict[str, bytes]:
    """Ids of pieces, each without white space but for one space before it, or nothing but white space."""
    blank = [c for c in pieces if c.isspace()]
    solid = [c for c in pieces if not c.isspace()]
    out = {c: np.asarray(e.ids, dtype="<u4").tobytes() for c, e in zip(blank, s["tok"].encode_batch_fast(blank, add_special_tokens=False))}
    if solid:
        marked = [c if c[0] == " " else "\n" + c for c in solid]
        ids = np.asarray(s["tok"].encode_batch_fast(["".join(marked)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.cumsum([len(c.encode()) for c in marked])
        upto = np.searchsorted(np.cumsum(s["sizes"][ids]), stops) + 1
        flat, start = ids.tobytes(), 0
        for c, m, stop in zip(solid, marked, upto.tolist()):
            out[c] = flat[4 * (start + (m is not c)) : 4 * stop]
            start = stop
    return out


def _is_odd(text: str, special: list[str]) -> bool:
    if _ODD_LOW.search(text) or any(x in text for x in special):
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_ODD[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())
    return False


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """For each text its ids as little-endian unsigned 32-bit integers; null counts as empty."""
    s = _loaded(path)
    cache, tok, special = s["cache"], s["tok"], s["special"]
    whole = lambda x: np.asarray(tok.encode_batch_fast([x], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()
    out: list[bytes] = []
    for text in texts:
        if not text:
            out.append(b"")
        elif _is_odd(text, special):
            out.append(whole(text))
        else:
            pieces = _PIECE.findall(text)
            ids = list(map(cache.get, pieces))
            if None in ids:
                new = list({c for c, i in zip(pieces, ids) if i is None})
                got = _encode_new(new, s)
                if len(cache) < CACHE_PIECES:
                    cache.update((c, i) for c, i in got.items() if len(c) <= LONGEST_PIECE)
                ids = [got[c] if i is None else i for c, i in zip(pieces, ids)]
            out.append(b"".join(ids))
    return out


def crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
