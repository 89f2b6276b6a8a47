"""Byte-level BPE ids of whole texts.

Texts are split into pre-tokens by array operations on code points; each distinct pre-token of a block is
encoded once and its ids are copied to wherever it stands. Ids are those of the tokenizer file.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array

import numpy as np

from sugarbeam.llm import kernels as K

# The pre-token pattern and white space of the byte-level tokenizer, and its special token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPECIAL = "<|endoftext|>"

#: Pre-tokens whose ids a worker remembers, and bytes of text it splits at once.
REMEMBERED = 50_000
BLOCK_BYTES = 1 << 18


@functools.cache
def _classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, for each code point."""
    kind = {"L": 0, "N": 1}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], 2) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = 3
    return out


def _printable_bytes() -> dict[str, int]:
    """The byte that each character of the vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder for a tokenizers file of a byte-level BPE vocabulary."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = _printable_bytes()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token != SPECIAL}
        self._piece = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._known: dict[str, bytes] = {}  # ids as bytes, which Python's collector need not visit

    @functools.cached_property
    def _whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of a block of texts (UTF-8 bytes and offsets): text i has ids[first[i]:first[i+1]]. Malformed bytes count as U+FFFD."""
        data, offsets = K.utf8(data, offsets)
        raw = data.tobytes()
        if SPECIAL.encode() in raw:
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            got = [np.array(self._whole.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int64)
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        text = raw.decode()
        head = np.flatnonzero((data & 0xC0) != 0x80)  # the byte where each code point begins
        at = np.searchsorted(head, offsets)
        start = pre_tokens(np.frombuffer(text.encode("utf-32-le"), np.uint32), at)
        begin = np.append(head, len(data))[start]
        end = np.append(begin[1:], len(data))
        h = K.span_hashes(K._BYTE_CASED[data], begin, end)
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        ends = np.append(start[1:], len(head))
        known, ids = self._known, []
        for a, b in zip(start[one].tolist(), ends[one].tolist(), strict=True):
            w = text[a:b]
            got = known.get(w)
            if got is None:
                got = array("I", self._piece(w.encode())).tobytes()
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(w) < 64:
                    known[w] = got
            ids.append(got)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), np.uint32)
        lead = np.cumsum(size) - size
        n = size[which]
        done = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.arange(done[-1]) + np.repeat(lead[which] - done[:-1], n)]
        return out, done[np.searchsorted(start, at)]


def pre_tokens(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in code points of texts laid end to end; `at` has the texts' offsets."""
    n = len(cp)
    kind = _classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    start[0] = True
    # White space before other characters of the same text: its last character stands alone or, a blank, leads the next token.
    last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~edge[1:n])
    start[last] = True
    start[last[cp[last] == 0x20] + 1] = False
    # Contractions, where an apostrophe begins a token.
    for q in np.flatnonzero((cp[:-1] == 0x27) & start[:-1] & (kind[1:] == 0) & ~edge[1:n]).tolist():
        tail = "".join(map(chr, cp[q + 1 : q + 3].tolist()))
        more = 1 if tail[0] in "stmd" else 2 if tail in ("re", "ve", "ll") and not edge[q + 2] else 0
        if more:
            start[q + 1] = False
            if q + 1 + more < n:
                start[q + 1 + more] = True
    return np.flatnonzero(start)


@functools.cache
def bpe(path: str) -> Bpe:
    """The encoder of a file, made once in each worker."""
    return Bpe(path)
