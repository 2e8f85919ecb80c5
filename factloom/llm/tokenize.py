"""Token ids of whole texts with a public byte-level BPE vocabulary, word by word."""

from __future__ import annotations

import os
import re

import numpy as np

from .common import _SPACE, span_hashes

#: White space beyond ASCII: texts with any of it are encoded in one go.
_WIDE = re.compile("[\x85\xa0  -     　]")
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalpha()]] = True


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """This process's encoder for a vocabulary; a worker keeps what it has learnt from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Encodes many texts: splits them where the vocabulary's own pattern always splits, and encodes
    each distinct piece once.

    Pieces start at a blank before a word, at a word that follows other white space, at white space
    after a word, at the last character of white space before a word unless it is a blank, and at an
    ASCII mark or digit right after an ASCII letter. The ids of a text are those of its pieces one
    after the other. Pieces are told apart by a 64-bit hash; `most` of them stay in memory.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # A text with the string of an added token is encoded in one go, as the token takes it apart.
        self.added = re.compile("|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) or "(?!)")
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.most = most
        self._forget()

    def _forget(self) -> None:
        """Known pieces: sorted hashes, and for each where its ids are among all."""
        self.known, self.begins, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.checks = np.zeros(0, np.uint32), np.zeros(0, np.uint64)

    def _learn(self, hashes: np.ndarray, checks: np.ndarray, texts: list[str]) -> None:
        """Encodes new pieces (their hashes sorted). Those that end in a word are encoded as lines of
        one text: a line break before a word is a token of its own."""
        lines = [bool(x.strip(" \t\n\r\x0b\x0c")) and not _WIDE.search(x) for x in texts]
        ids = self.tokenizer.encode_batch_fast(["\n".join(x for x, own in zip(texts, lines, strict=True) if own)], add_special_tokens=False)[0].ids
        ids = np.array(ids, np.int64)
        cuts = np.flatnonzero(ids == self.line)
        firsts, lasts = np.concatenate(([0], cuts + 1)), np.append(cuts, len(ids))
        size, begin = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        own = np.flatnonzero(lines)
        if len(own):
            size[own], begin[own] = lasts - firsts, firsts
        for i in np.flatnonzero(~np.array(lines, bool)).tolist():
            more = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
            size[i], begin[i] = len(more), len(ids)
            ids = np.append(ids, more)
        begin += len(self.flat)
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        at = np.searchsorted(self.known, hashes)
        self.checks = np.insert(self.checks, at, checks)
        self.known, self.begins, self.lengths = np.insert(self.known, at, hashes), np.insert(self.begins, at, begin), np.insert(self.lengths, at, size)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(data)
        space = _SPACE[data]
        blank = data == 32
        start = np.zeros(n, bool)
        start[offsets[:-1][offsets[:-1] < n]] = True
        if n > 1:
            next_solid = np.append(~space[1:], False)
            next_solid[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)] - 1] = False
            before = np.concatenate(([True], space[:-1]))
            before_blank = np.concatenate(([False], blank[:-1]))
            start |= space & next_solid  # the last white space before a word
            start |= space & ~before  # white space after a word
            start |= ~space & before & ~before_blank  # a word after other white space than a blank
            start |= _MARK[data] & np.concatenate(([False], _LETTER[data[:-1]]))
        return np.flatnonzero(start)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids start (and the end)."""
        raw = data.tobytes()
        starts = self.pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes, at, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        checks = span_hashes(data, starts[at], ends[at], 1)
        if len(self.known) + len(at) > self.most:
            self._forget()
        place = np.searchsorted(self.known, hashes)
        if len(self.known):
            found = np.minimum(place, len(self.known) - 1)
            if ((self.known[found] == hashes) & (self.checks[found] != checks)).any():  # another piece with this hash
                self._forget()
                place = np.zeros(len(hashes), np.int64)
        new = np.flatnonzero(self.known[np.minimum(place, len(self.known) - 1)] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(new):
            spans = zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)
            self._learn(hashes[new], checks[new], [raw[a:b].decode("utf-8", "replace") for a, b in spans])
            place = np.searchsorted(self.known, hashes)
        place = place[which]
        sizes, begins = self.lengths[place].astype(np.int64), self.begins[place]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.arange(upto[-1]) + np.repeat(begins - upto[:-1], sizes)]
        return ids, upto[np.searchsorted(starts, offsets)]

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text. `data` should hold a few MB; a longer text is cut at line or word starts."""
        ids, first = self.encode(data, offsets)
        out = [ids[first[i] : first[i + 1]] for i in range(len(offsets) - 1)]
        raw = data.tobytes()
        text = raw.decode("utf-8", "replace")
        if self.added.search(text) or ((data >= 0x80).any() and _WIDE.search(text)):
            for i in range(len(out)):
                own = raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
                if self.added.search(own) or _WIDE.search(own):
                    out[i] = np.array(self.tokenizer.encode(own, add_special_tokens=False).ids, np.uint32)
        return out
