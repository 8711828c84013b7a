"""Token ids of the public lower-casing BPE, with a word cache.

The tokenizer works word by word after NFC, white space folding and lower-casing, so the ids of a text
are the joined ids of its words. Texts of plain Latin characters (no combining marks, no control
characters: both libraries split and lower-case those alike) go through a bounded cache of words; all
others go to the tokenizer whole. Both ways give the tokenizer's own ids.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼-¾"
_WORD = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")  # the commonest first: no two start alike, save the last
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa0-įı-ɏ‐-‧‰-⁞€]")


class WordEncoder:
    """``encode_many(texts)``: the ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most_words: int = 300_000, group: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.most_words, self.group = most_words, group
        self.cache: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that close a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode_many(self, texts: Sequence[str], most_chars: int = 1_000_000) -> list[bytes]:
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            hi, chars = lo + 1, len(texts[lo])
            while hi < len(texts) and chars + len(texts[hi]) <= most_chars:
                chars += len(texts[hi])
                hi += 1
            out += self._encode_some(texts[lo:hi])
            lo = hi
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def _encode_some(self, texts: Sequence[str]) -> list[bytes]:
        words = [None if _ODD.search(t) else _WORD.findall(t.lower()) for t in texts]
        used = set().union(*(w for w in words if w))
        new = list(used.difference(self.cache))
        if len(self.cache) + len(new) > self.most_words:  # only words in use stay
            self.cache = {w: self.cache[w] for w in used if w in self.cache}
        self._learn(new)
        get = self.cache.__getitem__
        return [_pack(self.tokenizer.encode(t, add_special_tokens=False).ids) if w is None else b"".join(map(get, w)) for t, w in zip(texts, words)]

    def _learn(self, words: list[str]) -> None:
        """Words go through the tokenizer many at a time, set apart by blanks; a closing token ends each."""
        groups = [words[k : k + self.group] for k in range(0, len(words), self.group)]
        for part, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) == len(part):
                raw, at = ids.tobytes(), 0
                for w, cut in zip(part, cuts.tolist()):
                    self.cache[w] = raw[at:cut]
                    at = cut
            else:  # not seen for words of this alphabet
                for w, one in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                    self.cache[w] = _pack(one.ids)


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
