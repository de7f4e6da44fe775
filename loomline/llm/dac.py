"""Directly addressable codes: a file format for token ids with random access to every id.

Each id is cut into chunks from its low bits on. Level k holds, packed, the chunks of the ids that reach it, and a
bitmap that says which of them go on to level k + 1; a rank directory over the bitmap (set bits before every block of
512) gives an id's place there. The chunk widths minimise the size for the ids of the segment (a dynamic programme
over the histogram of bit lengths). Nothing is coded in blocks, so an id is read by one chunk per level.

A segment, little-endian: header; n_docs rows (doc_id int64, first id uint64, 1 if doc_id is NULL uint8) as three
arrays; for each level chunks, bitmap and directory, each padded with 8 zero bytes; crc32 of all that. A file holds
segments, a byte after each, and last their directory: the places where they begin as uint64, their number, a mark.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LLDAC001"
_HEAD = struct.Struct("<8sIIQQI")  # magic, part, sequence in the part, documents, ids, levels
_LEVEL = struct.Struct("<BQ")  # chunk width, ids at this level
_TAIL = struct.Struct("<Q8s")  # segments in the file, mark
_TAIL_MAGIC = b"LLDIR001"
_BLOCK = 512
_PAD = b"\0" * 8


def best_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths of least total size: chunks, and a bit for each id at all levels but the last."""
    if not len(ids):
        return [8]
    top = max(1, int(ids.max()).bit_length())
    if top <= 20:  # ids with more than s bits, from how often each id occurs
        counts = np.bincount(ids)
        longer = [int(counts[1 << s :].sum()) if s else len(ids) for s in range(top)]
    else:
        longer = [len(ids)] + [int(np.count_nonzero(ids >> np.uint32(s))) for s in range(1, top)]
    cost, step = [0.0] * (top + 1), [0] * (top + 1)
    for s in range(top - 1, -1, -1):
        cost[s], step[s] = min((longer[s] * (e - s + (e < top)) + cost[e], e) for e in range(s + 1, top + 1))
    widths, s = [], 0
    while s < top:
        widths.append(step[s] - s)
        s = step[s]
    return widths


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values below 2**16 are shifted together, eight into width bytes; wider ones go bit by bit."""
    if width < 16:
        out = []
        for i in range(0, len(values), 1 << 15):
            part = values[i : i + (1 << 15)].astype(np.uint32)
            n = len(part)
            part = np.pad(part, (0, -n % 8))
            two = part[0::2].astype(np.uint64) | part[1::2].astype(np.uint64) << np.uint64(width)
            four = two[0::2] | two[1::2] << np.uint64(2 * width)
            words = np.zeros((len(four) // 2, 1 if width <= 8 else 2), "<u8")
            words[:, 0] = four[0::2] | four[1::2] << np.uint64(4 * width)
            if width > 8:
                words[:, 1] = four[1::2] >> np.uint64(64 - 4 * width)
            out.append(words.view(np.uint8)[:, :width].tobytes()[: (n * width + 7) // 8])
        return b"".join(out)
    kind = np.dtype("<u2" if width <= 16 else "<u4")
    out = []
    for i in range(0, len(values), 1 << 19):  # whole bytes, for the number is a multiple of 8
        part = values[i : i + (1 << 19)].astype(kind)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, kind.itemsize), axis=1, count=width, bitorder="little")
        out.append(np.packbits(bits.reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def _unpack(data: memoryview, count: int, width: int) -> np.ndarray:
    out = np.empty(count, np.uint32)
    if width < 16:
        for i in range(0, count, 1 << 15):
            n = min(1 << 15, count - i)
            raw = np.frombuffer(data, np.uint8, (n * width + 7) // 8, i * width // 8)
            words = np.zeros((-(-n // 8), 8 if width <= 8 else 16), np.uint8)
            words[:, :width] = np.pad(raw, (0, len(words) * width - len(raw))).reshape(-1, width)
            words = words.view("<u8")
            last = words[:, 0] >> np.uint64(4 * width)
            if width > 8:
                last |= words[:, 1] << np.uint64(64 - 4 * width)
            rows = np.empty((len(words), 8), np.uint32)
            for k in range(8):
                rows[:, k] = (words[:, 0] if k < 4 else last) >> np.uint64(k % 4 * width) & np.uint64((1 << width) - 1)
            out[i : i + n] = rows.reshape(-1)[:n]
        return out
    kind = np.dtype("<u2" if width <= 16 else "<u4")
    for i in range(0, count, 1 << 19):
        n = min(1 << 19, count - i)
        raw = np.frombuffer(data, np.uint8, (n * width + 7) // 8, i * width // 8)
        bits = np.zeros((n, 8 * kind.itemsize), np.uint8)
        bits[:, :width] = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
        out[i : i + n] = np.packbits(bits.reshape(-1), bitorder="little").view(kind)
    return out


def _directory(flags: np.ndarray) -> np.ndarray:
    """Set bits before each block of the bitmap."""
    starts = np.arange(0, max(1, len(flags)), _BLOCK)
    counts = np.add.reduceat(flags.astype(np.uint64), starts) if len(flags) else np.zeros(1, np.uint64)
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u8")


def encode(part: int, sequence: int, doc_ids: list[int | None], starts: list[int], ids: np.ndarray) -> bytes:
    """A segment. starts: the place in ids of each document's first id."""
    ids = np.ascontiguousarray(ids, np.uint32)
    widths = best_widths(ids)
    body, levels, rest = [], [], ids
    for k, width in enumerate(widths):
        last = k == len(widths) - 1
        levels.append(_LEVEL.pack(width, len(rest)))
        body += [_pack(rest if last else rest & np.uint32((1 << width) - 1), width), _PAD]
        if not last:
            flags = (rest >> np.uint32(width)) > 0
            body += [np.packbits(flags, bitorder="little").tobytes(), _PAD, _directory(flags).tobytes(), _PAD]
            rest = rest[np.flatnonzero(flags)] >> np.uint32(width)
    docs = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(starts, "<u8").tobytes(), bytes(d is None for d in doc_ids)]
    out = b"".join([_HEAD.pack(MAGIC, part, sequence, len(doc_ids), len(ids), len(widths)), *levels, *docs, *body])
    return out + struct.pack("<I", zlib.crc32(out))


def directory(sizes: list[int]) -> bytes:
    """The end of a file of segments of these sizes, with what stands between them."""
    return np.cumsum([0, *sizes[:-1]]).astype("<u8").tobytes() + _TAIL.pack(len(sizes), _TAIL_MAGIC)


def places(data) -> list[int]:
    """Where the segments of a file begin, by its directory; one more byte, a line end, may follow that."""
    view = memoryview(data)
    for end in (len(view) - 1, len(view)):
        if end >= _TAIL.size and view[end - 8 : end] == _TAIL_MAGIC:
            count, _ = _TAIL.unpack_from(view, end - _TAIL.size)
            return np.frombuffer(view, "<u8", count, end - _TAIL.size - 8 * count).tolist()
    raise ValueError("not a file of segments of token ids")


class Segment:
    """A segment over a buffer, which may be a memory map: get reads the bytes of one id only."""

    def __init__(self, data, verify: bool = False) -> None:
        self._data = view = memoryview(data)
        magic, self.part, self.sequence, self.n_docs, self.n_ids, n_levels = _HEAD.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = _HEAD.size
        levels = [_LEVEL.unpack_from(view, at + k * _LEVEL.size) for k in range(n_levels)]
        at += n_levels * _LEVEL.size
        self._docs = np.frombuffer(view, "<i8", self.n_docs, at)
        self.starts = np.frombuffer(view, "<u8", self.n_docs, at + 8 * self.n_docs).astype(np.int64)
        self._null = np.frombuffer(view, np.uint8, self.n_docs, at + 16 * self.n_docs).astype(bool)
        at += 17 * self.n_docs
        self._levels = []  # width, count, place of chunks, bitmap and directory
        for k, (width, count) in enumerate(levels):
            chunks, bitmap, directory = at, 0, 0
            at += (count * width + 7) // 8 + len(_PAD)
            if k < n_levels - 1:
                bitmap = at
                directory = bitmap + (count + 7) // 8 + len(_PAD)
                at = directory + 8 * max(1, -(-count // _BLOCK)) + len(_PAD)
            self._levels.append((width, count, chunks, bitmap, directory))
        self.size = at + 4
        if verify and struct.unpack_from("<I", view, at)[0] != zlib.crc32(view[:at]):
            raise ValueError("a segment of token ids is damaged")

    @property
    def doc_ids(self) -> list[int | None]:
        return [None if null else int(d) for d, null in zip(self._docs, self._null, strict=True)]

    def get(self, i: int) -> int:
        """The i-th id, by one chunk and one rank per level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for k, (width, _, chunks, bitmap, directory) in enumerate(self._levels):
            first = i * width
            word = int.from_bytes(self._data[chunks + first // 8 : chunks + first // 8 + 8], "little")
            value |= ((word >> (first % 8)) & ((1 << width) - 1)) << shift
            shift += width
            if k == len(self._levels) - 1 or not self._data[bitmap + i // 8] >> (i % 8) & 1:
                break
            block = i // _BLOCK
            (before,) = struct.unpack_from("<Q", self._data, directory + 8 * block)
            bits = int.from_bytes(self._data[bitmap + block * _BLOCK // 8 : bitmap + i // 8 + 1], "little")
            i = before + (bits & ((1 << (i - block * _BLOCK)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level from the last one up."""
        out = np.empty(0, np.uint32)
        for k in range(len(self._levels) - 1, -1, -1):
            width, count, chunks, bitmap, _ = self._levels[k]
            low = _unpack(self._data[chunks:], count, width)
            if k < len(self._levels) - 1:
                flags = np.unpackbits(np.frombuffer(self._data, np.uint8, (count + 7) // 8, bitmap), count=count, bitorder="little").astype(bool)
                low[np.flatnonzero(flags)] |= out << np.uint32(width)
            out = low
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, each by random access."""
        end = self.starts[k + 1] if k + 1 < self.n_docs else self.n_ids
        return np.array([self.get(i) for i in range(self.starts[k], end)], np.uint32)
