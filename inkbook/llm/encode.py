"""Encoding with the public word BPE (lower case, white space dropped).

The library encodes a text piece by piece and no piece spans white space, so
the ids of a text are those of its words in a row. Words repeat a lot; each
worker keeps the ids of recent words in a bounded two-generation cache and
asks the library's model only about the others. Words with anything beyond
plain Latin letters, digits and ASCII signs go through the library's whole
pipeline."""
from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

#: Entries in each of the two generations of a cache.
CACHE = 300_000
DEFAULT_WORD_BPE = "word_bpe_49k.json"

_PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
#: The split pattern of the tokenizer file, for plain words.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+").findall


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, by name or as given."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level BPE files:
    printable Latin-1 bytes stand for themselves, the others for code points
    from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Cache:
    """Two generations: when the young one is full it becomes the old one."""

    def __init__(self, size: int = CACHE):
        self.size, self.young, self.old = size, {}, {}

    def put(self, key, value):
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        special = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)).search if special else None
        self.letters = str.maketrans({b: c for b, c in enumerate(byte_letters())})
        self.words, self.pieces = Cache(), Cache()

    def _piece(self, p: str) -> bytes:
        got = self.pieces.young.get(p)
        if got is not None:
            return got
        got = self.pieces.old.get(p)
        if got is None:
            # plain ASCII letters stand for themselves
            mapped = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
            got = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return self.pieces.put(p, got)

    def _word(self, w: str) -> bytes:
        got = self.words.old.get(w)
        if got is None:
            if not w:
                got = b""
            elif _PLAIN(w) and not (self.special and self.special(w)):
                got = b"".join([self._piece(p) for p in _PIECES(w.lower())])
            else:
                got = np.array(self.whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        # a giant "word" (no white space in megabytes) is not worth keeping
        return self.words.put(w, got) if len(w) <= 256 else got

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        find = self.words.young.get
        out = [find(w) for w in words]
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    w = words[i]
                    out[i] = self.words.young.get(w)
                    if out[i] is None:
                        out[i] = self._word(w)
        return b"".join(out)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    return WordEncoder(path)
