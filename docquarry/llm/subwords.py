"""Byte-level BPE ids at corpus speed.

The vocabulary is read from a tokenizers JSON file (a parameter, never copied) and run by a compiled BPE with the file's own
ranks, which gives the ids of the tokenizers library about five times faster.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa

from .common import _SPACE, text_buffer

#: The pre-tokeniser of byte-level BPE as published with its vocabulary (a fixed pattern).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space that the pattern cannot take in one go: its look-ahead steps back through the run and gives up near a million.
LONG_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")
#: Texts below this length hold no such run that matters.
LONG_TEXT = 100_000
#: Bytes that end a character other than white space, whatever stands before them.
_SOLID = ~_SPACE
_SOLID[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Subwords:
    def __init__(self, path: str | None = None):
        import tiktoken

        with open(path or default_path(), encoding="utf-8") as f:
            spec = json.load(f)
        cutter = json.dumps(spec.get("pre_tokenizer") or {})
        if '"ByteLevel"' not in cutter or '"Split"' in cutter or spec["model"].get("type", "BPE") != "BPE":
            raise ValueError(f"{path or default_path()}: not a byte-level BPE vocabulary with the published pre-tokeniser")
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        alphabet = _byte_of()
        ranks = {bytes(alphabet[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.size = max([*ranks.values(), *special.values()]) + 1
        self.tokens = {v: k for k, v in ranks.items()}
        self._special = special
        #: bytes of each id
        self.width = np.zeros(self.size, np.int64)
        for x, i in [*ranks.items(), *((x.encode(), i) for x, i in special.items())]:
            self.width[i] = len(x)
        self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit numbers; the special tokens' strings are those tokens.

        A text of any length is encoded whole, in time and memory in proportion.
        """
        if len(text) < LONG_TEXT:
            return self._plain(text)
        out, done = [], 0
        for m in LONG_SPACE.finditer(text):
            # the pattern takes such a run but for its last character, or all of it before the end or a special token
            last = m.end() == len(text) or text.startswith(tuple(self._special), m.end())
            stop = m.end() - (not last)
            out += [self._plain(text[done : m.start()]), array("I", self._encoding._encode_single_piece(text[m.start() : stop].encode())).tobytes()]
            done = stop
        return b"".join([*out, self._plain(text[done:])])

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin and the last one's end) of UTF-8 texts as by text_buffer().

        No token goes on from a character into white space, so texts are cut there.  A stretch that stands in several places is encoded
        once, with the others in one text; the first and last of each text have no such cut at both ends and are encoded apart.
        """
        if not len(data) or any(set(x) & set(" \t\n\v\f\r") for x in self._special):
            ids = [np.frombuffer(self.encode(data[a:b].tobytes().decode()), "<u4") for a, b in zip(offsets[:-1], offsets[1:])]
            return np.concatenate([np.empty(0, "<u4"), *ids]), np.cumsum([0, *map(len, ids)])
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = _SPACE[data[1:]] & _SOLID[data[:-1]]
        cut[offsets] = True
        begin = np.flatnonzero(cut)
        size = np.diff(begin)
        first = np.searchsorted(begin, offsets)  # of each text, and one past the last stretch
        inner = np.ones(len(size), bool)
        full = first[1:] > first[:-1]
        inner[first[:-1][full]] = inner[first[1:][full] - 1] = False
        mask = pa.py_buffer(np.packbits(inner, bitorder="little").tobytes())
        parts = pa.Array.from_buffers(pa.large_binary(), len(size), [mask, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        joined, ends = text_buffer(parts.dictionary)
        text = joined.tobytes().decode()
        common = np.frombuffer(self.encode(text) if size.max() >= 50_000 else self._plain(text), "<u4")
        ends = np.searchsorted(np.cumsum(self.width[common]), ends[1:], "left") + 1 if len(common) else ends[1:]
        apart = np.flatnonzero(~inner)
        others = [np.frombuffer(self.encode(data[begin[k] : begin[k + 1]].tobytes().decode()), "<u4") for k in apart.tolist()]
        pool = np.concatenate([common, *others])
        ends = np.concatenate((ends, len(common) + np.cumsum([len(x) for x in others], dtype=np.int64)))
        which = parts.indices.fill_null(0).to_numpy().astype(np.int64)
        which[apart] = len(parts.dictionary) + np.arange(len(apart))
        count = np.diff(ends, prepend=0)[which]
        done = np.concatenate(([0], np.cumsum(count)))
        place = np.repeat(ends[which] - done[1:], count) + np.arange(done[-1])
        return pool[place], done[first]

    def _plain(self, text: str) -> bytes:
        if any(s in text for s in self._special):
            return array("I", self._encoding.encode(text, allowed_special="all")).tobytes()
        return array("I", self._encoding.encode_ordinary(text)).tobytes()

    def sentence_tables(self):
        """(token ends a sentence, token starts with white space) as boolean arrays by id."""
        ends, begins = np.zeros(self.size, bool), np.zeros(self.size, bool)
        for i, t in self.tokens.items():
            ends[i] = t.endswith((b".", b"!", b"?"))
            begins[i] = t[:1] in (b" ", b"\n")
        return ends, begins


_loaded: dict[tuple, Subwords] = {}


def subwords(path: str | None = None) -> Subwords:
    """One encoder for each process."""
    key = (path,)
    if key not in _loaded:
        _loaded[key] = Subwords(path)
    return _loaded[key]
