"""Whole texts to token ids with a tokenizer of the tokenizers library, through ids kept for the parts of words seen lately.

A text is cut into the pre-tokenizer's own parts (letters, digits, other signs, contractions, white space); only parts
that are not kept reach the library, many in one call and without the steps that change nothing in them. That holds for
ASCII, common punctuation and Latin letters without combining marks, where cutting and lowering are certain. A text
with any other sign is first cut before each space that has no white space beside it (byte-level BPE takes that space
into the next piece; BPE with word ends drops it), and its pieces with other signs are encoded by the library as they
are; so is a text with the string of a special token, which means what it means to the library.
"""

from __future__ import annotations

import itertools
import re

import numpy as np

#: Parts that are kept; of them, when there are more, those seen first, which are the frequent ones; signs of one that is not kept.
_KEEP, _STAY, _LONG = 600_000, 150_000, 64
#: Signs cut at once: a longer text is cut between words, a call takes so many signs together.
_CHUNK = 1 << 21
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_PLAIN = re.compile(r"[\n\x20-\x7e\xa1-įı-ſ\u2010-\u2027\u2030-\u205e€]*")  # without U+0130, which lowers to two signs
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
_JOINED_PARTS = re.compile(rf"{_CONTRACTED}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
_WORD_PARTS = re.compile(rf"{_CONTRACTED}|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_WORD_END = "</w>"
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_OTHER = "\0"  # begins what is kept of a piece with other signs
_encoders: dict[tuple[str, bool], TextEncoder] = {}


def encoder_of(path: str, joined: bool) -> TextEncoder:
    """The process's encoder: a Python worker serves many tasks, which share the tokenizer and what it has kept."""
    if (path, joined) not in _encoders:
        _encoders[path, joined] = TextEncoder(path, joined)
    return _encoders[path, joined]


def _byte_signs() -> dict[str, str]:
    """The sign that byte-level models have for each byte (as a latin-1 sign): itself if it is printable, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = itertools.count(256)
    return {chr(b): chr(b if b in printable else next(others)) for b in range(256)}


class TextEncoder:
    """joined: the space before a word is part of it (byte-level BPE). False: spaces are dropped and letters lowered (BPE with word ends)."""

    def __init__(self, path: str, joined: bool) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._joined = joined
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        # The same model for parts alone, one a line, whose bytes already have the signs that the model has for them:
        # nothing to normalise or to cut in them.
        self._lines = Tokenizer.from_file(path)
        self._lines.normalizer = None
        self._lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self._signs = str.maketrans(_byte_signs() | {"\n": "\n"})
        vocabulary = self._tokenizer.get_vocab()
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # of a token; its string has one sign a byte
        for token, i in vocabulary.items():
            self._bytes[i] = len(token) - (0 if joined else len(_WORD_END) * token.endswith(_WORD_END))
        self.n_ids = len(self._bytes)
        self._known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """The parts as lines of one text, cut again by the bytes of its tokens; part by part if that doesn't give the parts."""
        if not parts:
            return []
        lines = "\n".join(parts).encode().decode("latin-1").translate(self._signs)
        ids = np.array(self._lines.encode_batch_fast([lines], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(list(map(len, lines.split("\n"))))
        behind = np.cumsum(self._bytes[ids])
        cuts = np.searchsorted(behind, ends)
        if not len(ids) or cuts[-1] != len(ids) - 1 or not np.array_equal(behind[cuts], ends):
            return self._encode(parts)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(cuts[:-1] + 1).tolist()], (cuts + 1).tolist(), strict=True)]

    def _cut(self, text: str) -> list[str]:
        """A text as parts, and as pieces marked _OTHER where there are other signs."""
        if _PLAIN.fullmatch(text):
            return _JOINED_PARTS.findall(text) if self._joined else _WORD_PARTS.findall(text.lower())
        pieces = text.split(" ")
        if not self._joined:
            return [part for piece in pieces for part in (_WORD_PARTS.findall(piece.lower()) if _PLAIN.fullmatch(piece) else [_OTHER + piece])]
        if any(not p or p[0].isspace() or p[-1].isspace() for p in pieces):
            return [_OTHER + text]
        pieces[1:] = [" " + p for p in pieces[1:]]
        return [part for piece in pieces for part in (_JOINED_PARTS.findall(piece) if _PLAIN.fullmatch(piece) else [_OTHER + piece])]

    def _ids(self, texts: list[str]) -> list[bytes]:
        known = self._known
        if len(known) > _KEEP:
            known = self._known = dict(itertools.islice(known.items(), _STAY))
        cut = list(map(self._cut, texts))
        wanted: set[str] = set().union(*cut)
        new = wanted.difference(known)
        lone = [p for p in new if len(p) > _LONG or p[0] == _OTHER or p.isspace()]
        alone = dict(zip(lone, self._encode([p.removeprefix(_OTHER) for p in lone]), strict=True))
        new.difference_update(lone)
        wanted.difference_update(lone)
        order = list(new)
        for i in range(0, len(order), 512):
            some = order[i : i + 512]
            known.update(zip(some, self._encode_parts(some), strict=True))
        known.update((p, ids) for p, ids in alone.items() if len(p) <= _LONG)
        # Each word of these texts is looked up once among all that are kept, then in a table that fits in a cache.
        near = dict(zip(wanted, map(known.__getitem__, wanted), strict=True)) | alone
        return [b"".join(map(near.__getitem__, parts)) for parts in cut]

    def _chunks(self, text: str) -> list[str]:
        """The text, cut between words if it is long."""
        out = []
        while len(text) > _CHUNK and (between := _BETWEEN.search(text, _CHUNK)):
            out.append(text[: between.start()])
            text = text[between.start() :]
        return [*out, text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        places: list[int] = []
        held: list[str] = []
        signs = 0
        for k, text in enumerate(texts):
            if any(s in text for s in self._special):
                out[k] = self._encode([text])
                continue
            for chunk in self._chunks(text):
                if signs and signs + len(chunk) > _CHUNK:
                    for place, ids in zip(places, self._ids(held), strict=True):
                        out[place].append(ids)
                    places, held, signs = [], [], 0
                places.append(k)
                held.append(chunk)
                signs += len(chunk)
        for place, ids in zip(places, self._ids(held), strict=True):
            out[place].append(ids)
        return [b"".join(ids) for ids in out]
