"""Tokenizing whole texts with the ``tokenizers`` library, fast enough for a corpus.

Word-end BPE and byte-level BPE never merge across the edges of their
pre-tokens, so the ids of a text are the ids of its chunks one after another,
where a chunk ends at edges that are certain from the bytes alone: between
letters, digits and punctuation (not after an apostrophe, which may start a
contraction), and around ASCII white space. Where a byte leaves doubt, as next
to rarer scripts' marks and spaces, there is no edge and the chunk is longer.

All chunks of some MB of text are found with numpy, made distinct by Arrow, and
each distinct one is given to the library once; its ids are kept. Chunks of
plain letters go to the library's model without its normaliser and
pre-tokenizer, which leave them as they are; all others go the whole way.
Tokenizers of any other layout encode whole texts.
"""

from __future__ import annotations

import codecs
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a byte can be. UNSURE may be white space, a mark that composes with its neighbour, or not known; OTHER is neither.
_BLANK, _SPACE, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER, _UNSURE = range(8)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _UNSURE, np.uint8)
    kinds[33:127] = _MARK
    kinds[[9, 10, 11, 12, 13]] = _SPACE
    for first, last, kind in ((" ", " ", _BLANK), ("0", "9", _DIGIT), ("A", "Z", _LETTER), ("a", "z", _LETTER), ("'", "'", _APOSTROPHE)):
        kinds[ord(first) : ord(last) + 1] = kind
    return kinds


_KINDS = _byte_kinds()
#: Lead bytes of characters that are neither white space nor of unclear kind in any version of Unicode's tables.
_SURE_LEADS = np.zeros(256, bool)
_SURE_LEADS[[*range(0xC3, 0xE0), 0xE0, *range(0xE4, 0xEE), *range(0xF0, 0xF5)]] = True


def _edge_table() -> np.ndarray:
    """Whether a chunk ends between a byte of one kind and one of another: 8 * before + after."""
    edge = np.zeros((8, 8), bool)
    solid = (_LETTER, _DIGIT, _MARK)
    for a in solid:
        for b in solid:
            edge[a, b] = a != b
    edge[[_LETTER, _DIGIT], _APOSTROPHE] = True
    for a in (*solid, _APOSTROPHE, _OTHER):
        edge[a, [_BLANK, _SPACE]] = True
        edge[_SPACE, a] = True
    return edge.ravel()


def _last_space_table() -> np.ndarray:
    """Whether a chunk ends before the first of two bytes: the last white space of a run goes with what follows or alone."""
    last = np.zeros((8, 8), bool)
    for a in (_LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER):
        last[[_BLANK, _SPACE], a] = True
    return last.ravel()


_EDGES, _LAST_SPACE = _edge_table(), _last_space_table()
#: Chunks in one string for the library.
_JOINED = 256


def _byte_letters() -> str:
    """The character that byte-level tokenizers write for each byte: itself where it prints, else the next one from 256 on."""
    plain = {*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(spare)) for b in range(256))


_BYTE_LETTERS = _byte_letters()
_JOIN_LETTERS = _BYTE_LETTERS[:10] + "\n" + _BYTE_LETTERS[11:]


def _kinds_of(b: np.ndarray) -> np.ndarray:
    """The kind of every byte of UTF-8 text."""
    kinds = _KINDS[b]
    high = np.flatnonzero(b & 0x80)
    if len(high):
        value = b[high]
        lead = np.maximum.accumulate(np.where(value >= 0xC0, np.arange(len(high)), 0))
        first = value[lead]
        own = np.where(_SURE_LEADS[first], _OTHER, _UNSURE).astype(np.uint8)
        # U+00C0 to U+00FF, letters but for two signs
        latin = first == 0xC3
        second = value[np.minimum(lead + 1, len(high) - 1)]
        own[latin & (second != 0x97) & (second != 0xB7)] = _LETTER
        kinds[high] = own
    return kinds


def _lowered(b: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Letters up to U+00FF in lower case, but for those before a character that may compose with them."""
    out = b.copy()
    letter = kinds == _LETTER
    letter[:-1] &= (kinds[1:] != _UNSURE) & (kinds[1:] != _OTHER)
    big = letter & (b >= 65) & (b <= 90)
    out[big] += 32
    second = np.flatnonzero(letter[1:] & (b[:-1] == 0xC3)) + 1
    second = second[b[second] <= 0x9E]
    out[second] += 32
    return out


class _Index(dict):
    """chunk -> number; unknown chunks get the next one and are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, chunk):
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


def _roomy(x: np.ndarray, n: int) -> np.ndarray:
    """The array with room for ``n`` entries and a quarter more, where it has less."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(n + n // 4 - len(x), x.dtype)])


class CachedEncoder:
    """``encode(texts)`` gives all ids one after another and the number of ids of each text.

    ``keep`` bounds the chunks that stay known between calls (about 200 bytes each; a
    chunk of over 64 bytes counts for several): beyond it, those that a call adds are
    forgotten after it. When most distinct chunks of a call turn out to be unknown
    then, what is kept no longer fits and all is forgotten.
    """

    def __init__(self, path: str, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, normal, vocab = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}, self.tok.get_vocab(True)
        self.size = max(vocab.values()) + 1
        self.mode = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal:
            self.mode = "bytes"
        elif [n["type"] for n in normal.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix"):
            split = pre["pretokenizers"][0] if pre.get("type") == "Sequence" else {}
            if split.get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in (split["pattern"].get("Regex") or ""):
                self.mode = "words"
        if self.mode != "whole":
            suffix = spec["model"].get("end_of_word_suffix") or ""
            self.n_bytes = np.zeros(self.size, np.int64)
            for piece, k in vocab.items():
                self.n_bytes[k] = len(piece.removesuffix(suffix) if suffix else piece)
            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True
            if self.mode == "words":
                from tokenizers import normalizers

                self.model.normalizer = normalizers.Sequence([])
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.keep = keep
        self._reset()

    def _reset(self):
        self.index = _Index()
        self.flat = np.zeros(1 << 16, np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.used = self.weight = self.known = 0
        self.start = np.zeros(1 << 16, np.int32)
        self.count = np.zeros(1 << 16, np.int32)

    @staticmethod
    def _raw(tok, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which chunks are letters only that the normaliser leaves as they are; byte-level ones may have a blank first."""
        kinds = _kinds_of(data)
        letter = kinds == _LETTER
        if self.mode == "words":
            letter &= (data < 65) | (data > 90)
            letter[1:] &= (data[:-1] != 0xC3) | (data[1:] > 0x9E)
        else:
            alone = np.diff(np.append(starts, len(data))) == 1
            letter[starts] |= (kinds[starts] == _BLANK) & ~alone
        return np.logical_and.reduceat(letter, starts)

    def _encode_new(self, chunks: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks in any order, and where those of each chunk start and how many they are."""
        start, count = np.zeros(len(chunks), np.int64), np.full(len(chunks), -1, np.int64)
        fast = np.flatnonzero(self._plain(np.frombuffer(b"".join(chunks), np.uint8), np.cumsum(size) - size))
        parts = [fast[k : k + _JOINED] for k in range(0, len(fast), _JOINED)]
        joined = [codecs.charmap_decode(b"\n".join([chunks[k] for k in p.tolist()]), "strict", _JOIN_LETTERS)[0] for p in parts]
        flat, used = [], 0
        for part, ids in zip(parts, self._raw(self.model, joined)):
            ends = np.cumsum(size[part])
            at = np.cumsum(self.n_bytes[ids])
            last = np.searchsorted(at, ends, "left") + 1
            if last[-1] != len(ids) or (at[last - 1] != ends).any():
                continue  # not pieces of these bytes: the whole way
            first = np.concatenate([[0], last[:-1]])
            start[part], count[part] = used + first, last - first
            flat.append(ids)
            used += len(ids)
        left = np.flatnonzero(count < 0)
        for k, ids in zip(left.tolist(), self._raw(self.tok, [chunks[k].decode("utf-8", "replace") for k in left.tolist()])):
            start[k], count[k] = used, len(ids)
            flat.append(ids)
            used += len(ids)
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), start, count

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        if not new:
            return
        size = np.fromiter(map(len, new), np.int64, len(new))
        flat, start, count = self._encode_new(new, size)
        self.flat = _roomy(self.flat, self.used + len(flat))
        self.start, self.count = (_roomy(x, self.known + len(new)) for x in (self.start, self.count))
        self.flat[self.used : self.used + len(flat)] = flat
        at = slice(self.known, self.known + len(new))
        self.start[at], self.count[at] = self.used + start, count
        self.used += len(flat)
        self.known += len(new)
        self.weight += len(new) + int((size >> 6).sum())

    def _chunks(self, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that count, where the chunks start in them, and where each text does."""
        kinds = _kinds_of(b)
        pair = (kinds[:-1] << 3) | kinds[1:]
        edge = np.zeros(len(b), bool)
        edge[1:] = _EDGES[pair]
        if self.mode == "words":  # white space does not count
            edge[1:] |= (kinds[:-1] <= _SPACE) & (kinds[1:] > _SPACE)
            edge[starts[starts < len(b)]] = True
            solid = kinds > _SPACE
            before = np.concatenate([[0], np.cumsum(solid)])
            # a text may start with white space, the chunk that follows it with its first solid byte
            return _lowered(b, kinds)[solid], np.flatnonzero(edge[solid]), before[starts]
        edge[:-1] |= _LAST_SPACE[pair]
        edge[starts[starts < len(b)]] = True
        return b, np.flatnonzero(edge), starts

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Null texts count as empty. Call it with a few MB of text at most."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if self.mode == "whole":
            ids = self._raw(self.tok, [t or "" for t in column.to_pylist()])
            return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), np.fromiter(map(len, ids), np.int64, len(ids))
        # without its nulls, an array's values lie one after another
        column = pc.fill_null(column, "").cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        b = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(column) else np.zeros(0, np.uint8)
        if not len(b):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        b, first, starts = self._chunks(b, at - at[0])
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        offsets = np.append(first, len(b)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(b))]).dictionary_encode()
        before = self.known, self.used, self.weight
        known = chunks.dictionary
        edges = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1].tolist()
        data = known.buffers()[2].to_pybytes()
        distinct = [data[i:j] for i, j in zip(edges, edges[1:])]
        which = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        new = self.index.new
        self._learn()
        which = which[chunks.indices.to_numpy()]
        count = self.count[which].astype(np.int64)
        ends = np.cumsum(count)
        place = np.repeat(self.start[which] - (ends - count), count)
        place += np.arange(int(ends[-1]))
        ids = self.flat[place].astype(np.uint32)
        if self.weight > self.keep:
            if 2 * len(new) > len(distinct):
                self._reset()
            else:
                for chunk in new:
                    del self.index[chunk]
                self.known, self.used, self.weight = before
        sums = np.concatenate([[0], ends])[np.searchsorted(first, starts)]
        return ids, np.diff(sums)


_ENCODERS: dict[tuple[str, int], CachedEncoder] = {}


def encoder(path: str, keep: int = 600_000) -> CachedEncoder:
    """One encoder for each path and bound in a worker."""
    if (path, keep) not in _ENCODERS:
        _ENCODERS[path, keep] = CachedEncoder(path, keep)
    return _ENCODERS[path, keep]


def forget_encoders() -> None:
    """Frees what this worker's encoders hold."""
    _ENCODERS.clear()


def groups(texts: pa.Array, most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about so many bytes in all; a longer text stands alone."""
    a, size = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if k > a and size + n > most:
            yield a, k
            a, size = k, 0
        size += n
    if a < len(texts):
        yield a, len(texts)
