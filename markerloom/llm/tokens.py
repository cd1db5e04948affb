"""Ids and character spans of whole texts, with the vocabulary of a tokenizers file.

A byte-level BPE splits a text by a fixed pattern before it merges, and no token reaches over a split. A blank,
tab or line end after another kind of character always begins a new piece, and so does an ASCII sign after an ASCII letter or
digit, so a text is cut there into chunks, and each distinct chunk is encoded once by the library; the ids of the text are those
of its chunks in order. Chunks are looked up with array operations, many texts at a time: one of up to SHORT bytes is two
numbers, its bytes and its length.
Texts with other kinds of white space, where the pattern looks further, texts with the string of an added token, and tokenizers
of other kinds are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from zlib import crc32

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import SparkContext

# Chunks that a Python worker remembers, at some 60 bytes each; beyond that it forgets the longer half, the rarer words.
MEMO = 1_000_000
SHORT = 15
# Words that the library remembers, for texts that are encoded whole; its own default.
LIBRARY_MEMO = 10_000

_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD = b"\x0b\x0c\x1c\x1d\x1e\x1f"

_U = np.uint64
# The bytes of a chunk of each length in its two numbers; the last byte is the length.
_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(SHORT + 1)], _U)
_HIGH = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(SHORT + 1)], _U)
_LENGTH = np.arange(SHORT + 1, dtype=_U) << _U(56)

# The sign of every byte in a byte-level vocabulary.
_SIGNS = np.arange(256, dtype="<u4")
_OTHER = [*range(33), *range(127, 161), 173]
_SIGNS[_OTHER] = 256 + np.arange(len(_OTHER))

_LOADED: dict[int, Encoder] = {}


def _spaces(buffer: np.ndarray) -> np.ndarray:
    return (buffer == 32) | (buffer == 9) | (buffer == 10) | (buffer == 13)


def _starts(buffer: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where chunks start: each text, each run of white space after something else, and each ASCII sign after a letter or digit."""
    space = _spaces(buffer)
    word = ((buffer | 32) - np.uint8(97) < 26) | (buffer - np.uint8(48) < 10)
    first = (buffer > 32) & (buffer < 127) & ~word
    first[1:] &= word[:-1]
    first[1:] |= space[1:] & ~space[:-1]
    first[texts[texts < len(buffer)]] = True
    return np.flatnonzero(first)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, in order, and where each range begins among them."""
    ends = np.cumsum(lengths)
    firsts = ends - lengths
    at = np.repeat(starts - firsts, lengths)
    at += np.arange(len(at))
    return at, firsts


def _words(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which chunks are a blank and letters, ASCII or of two bytes from C3 on, and so one piece of the pattern."""
    at, firsts = _ranges(starts, lengths)
    if not len(at):
        return np.zeros(0, bool)
    some = buffer.take(at)
    after = np.zeros(len(some), bool)
    after[1:] = some[:-1] == 0xC3
    letter = ((some | 32) - np.uint8(97) < 26) | (some == 0xC3) | (after & (some != 0x97) & (some != 0xB7))
    letter[firsts] = some[firsts] == 32
    return np.logical_and.reduceat(letter, firsts) & (lengths > 1)


class _Chunks:
    """A hash table of chunks: open places hold the number of an entry, entry 0 is none."""

    def __init__(self):
        self._place = np.zeros(1 << 12, np.int32)
        self._low, self._high = np.zeros(1, _U), np.zeros(1, _U)
        self._first, self._counts = np.zeros(1, np.int64), np.zeros(1, np.int32)
        self._ids = np.zeros(0, np.uint32)
        self._n, self._used = 1, 0
        self._long: dict[bytes, int] = {}

    def __len__(self) -> int:
        return self._n - 1

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * _U(0xC2B2AE3D27D4EB4F))) * _U(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> _U(32))) * _U(0xBF58476D1CE4E5B9) >> _U(65 - len(self._place).bit_length())).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entries of short chunks, 0 for unknown ones."""
        at = self._home(low, high)
        found = self._place.take(at)
        other = np.flatnonzero((found != 0) & ((self._low.take(found) != low) | (self._high.take(found) != high)))
        at = at[other]
        while len(other):
            at = (at + 1) & (len(self._place) - 1)
            here = self._place.take(at)
            found[other] = here
            wrong = (here != 0) & ((self._low.take(here) != low[other]) | (self._high.take(here) != high[other]))
            other, at = other[wrong], at[wrong]
        return found

    def find_long(self, chunk: bytes) -> int:
        return self._long.get(chunk, 0)

    def _put(self, entries: np.ndarray) -> None:
        at = self._home(self._low[entries], self._high[entries])
        while len(entries):
            free = self._place[at] == 0
            self._place[at[free]] = entries[free]
            lost = self._place[at] != entries
            entries, at = entries[lost], (at[lost] + 1) & (len(self._place) - 1)

    def _room(self, name: str, used: int, more: int) -> np.ndarray:
        held = getattr(self, name)
        if used + more > len(held):
            held = np.concatenate([held[:used], np.zeros(more + max(used, 1024) // 2, held.dtype)])
            setattr(self, name, held)
        return held

    def add(self, low: np.ndarray, high: np.ndarray, long: list[bytes], counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """New entries for unknown chunks; those without a length in `high` are long and go by their bytes."""
        n, m = self._n, len(low)
        new = np.arange(n, n + m, dtype=np.int32)
        ends = np.cumsum(counts)
        for name, values in (("_low", low), ("_high", high), ("_first", self._used + ends - counts), ("_counts", counts)):
            self._room(name, n, m)[n : n + m] = values
        self._room("_ids", self._used, len(ids))[self._used : self._used + len(ids)] = ids
        self._n, self._used = n + m, self._used + len(ids)
        short = high >= _LENGTH[1]
        self._long.update(zip(long, new[~short].tolist()))
        if 2 * self._n > len(self._place):
            self._place = np.zeros(1 << (2 * self._n).bit_length(), np.int32)
            every = np.arange(1, self._n, dtype=np.int32)
            self._put(every[self._high[1 : self._n] >= _LENGTH[1]])
        else:
            self._put(new[short])
        return new

    def ids_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries, in order, and how many each has."""
        counts = self._counts.take(entries).astype(np.int64)
        at = np.repeat(self._first.take(entries) - (np.cumsum(counts) - counts), counts)
        at += np.arange(len(at))
        return self._ids.take(at), counts

    def shorter_half(self) -> _Chunks:
        lengths = self._high[1 : self._n] >> _U(56)
        kept = 1 + np.flatnonzero((lengths < np.median(lengths)) & (lengths > 0))
        out = _Chunks()
        if len(kept):
            ids, counts = self.ids_of(kept)
            out.add(self._low[kept], self._high[kept], [], counts, ids)
        return out


class Encoder:
    """Encodes texts as the library does without adding special tokens. A text that holds the string of an added token, which the
    library finds before it splits, is encoded whole."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self._tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        before = parts.get("pre_tokenizer") or {}
        added = [t["content"] for t in parts.get("added_tokens") or []]
        self._added = added
        self.chunked = (
            parts.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and parts["model"].get("type") == "BPE"
        )
        self._known = _Chunks()
        if self.chunked:
            # In a byte-level vocabulary a token has one character for each of its bytes.
            size = self._tokenizer.get_vocab_size()
            # Splits at blanks alone, for texts that are pieces of the pattern in signs.
            self._words = Tokenizer(self._tokenizer.model)
            self._words.pre_tokenizer = WhitespaceSplit()
            self._bytes = np.array([len(self._tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)

    def forget(self) -> None:
        """Drop the remembered chunks."""
        self._known = _Chunks()

    def _remember(self, words: int) -> None:
        """How many words the library remembers the ids of."""
        resize = getattr(self._tokenizer.model, "_resize_cache", None)
        if resize is not None:
            resize(words)

    def _whole(self, texts: list[str]):
        return self._tokenizer.encode_batch(texts, add_special_tokens=False)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        # Without offsets, which cost the library as much again.
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of chunks that begin with white space and end without, and how many each has: first those of `words`, then the
        others. Each kind forms one text, whose ids are cut at the chunks' ends by their lengths in bytes."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        # None of these comes again, so the library need not remember them.
        self._remember(0)
        for whole, some in ((True, words), (False, ~words)):
            begins, sizes = starts[some], lengths[some]
            if not len(begins):
                continue
            if whole:
                at, firsts = _ranges(begins - 1, sizes + 1)
                signs = _SIGNS.take(buffer.take(at, mode="clip"))
                signs[firsts] = ord("\n")
                text, by = signs.tobytes().decode("utf-32-le"), self._words
            else:
                text, by = buffer.take(_ranges(begins, sizes)[0]).tobytes().decode(), self._tokenizer
            found = np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends, reached = np.cumsum(sizes), np.cumsum(self._bytes[found])
            cuts = np.searchsorted(reached, ends)
            if not np.array_equal(reached[cuts], ends):
                raise AssertionError("a token reaches over a chunk's end")
            ids.append(found)
            counts.append(np.diff(cuts, prepend=-1))
        self._remember(LIBRARY_MEMO)
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entries for new chunks."""
        joins = _spaces(buffer[starts]) & ~_spaces(buffer[starts + lengths - 1])
        words = joins & _words(buffer, starts, lengths)
        order = np.argsort(~joins * np.int8(2) + (joins & ~words), kind="stable")
        starts, lengths, joined = starts[order], lengths[order], int(joins.sum())
        ids, counts = self._joined(buffer, starts[:joined], lengths[:joined], words[order[:joined]])
        rest = self._plain([buffer[a : a + n].tobytes().decode() for a, n in zip(starts[joined:].tolist(), lengths[joined:].tolist())])
        counts = np.concatenate([counts, np.array([len(x) for x in rest], np.int64)])
        long = np.flatnonzero(lengths > SHORT)
        chunks = [buffer[a : a + n].tobytes() for a, n in zip(starts[long].tolist(), lengths[long].tolist())]
        entries = np.zeros(len(order), np.int64)
        entries[order] = self._known.add(low[order], high[order], chunks, counts, np.concatenate([ids, *rest]))
        return entries

    def _entries(self, data: bytes, buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The entry of each chunk of the buffer, which has a few bytes more."""
        lengths = np.diff(starts, append=len(data))
        sizes = np.where(lengths <= SHORT, lengths, 0)
        both = sliding_window_view(buffer, 16)[starts].view("<u8")
        low, high = both[:, 0] & _LOW.take(sizes), (both[:, 1] & _HIGH.take(sizes)) | _LENGTH.take(sizes)
        entries = self._known.find(low, high).astype(np.int64)
        known: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(sizes == 0).tolist():
            chunk = data[starts[i] : starts[i] + lengths[i]]
            entries[i] = self._known.find_long(chunk)
            if not entries[i]:
                known.setdefault(chunk, []).append(i)
        new = np.flatnonzero((entries == 0) & (sizes > 0))
        # Equal ones side by side; by a rare chance others come between, and a chunk gets two entries.
        order = new[np.argsort(low[new] * _U(0x9E3779B97F4A7C15) ^ high[new] * _U(0xC2B2AE3D27D4EB4F))]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
        firsts = np.r_[order[fresh], np.array([x[0] for x in known.values()], np.int64)].astype(np.int64)
        if len(firsts):
            learned = self._learn(buffer, starts[firsts], lengths[firsts], low[firsts], high[firsts])
            short = int(fresh.sum())
            entries[order] = learned[:short][np.cumsum(fresh) - 1]
            for entry, places in zip(learned[short:].tolist(), known.values()):
                entries[places] = entry
        return entries

    def _has_added(self, text: str) -> bool:
        return any(a in text for a in self._added)

    def _in_chunks(self, text: str) -> bool:
        return self.chunked and not (self._has_added(text) or (not text.isascii() and _OTHER_SPACE.search(text)))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self._known) > MEMO:
            self._known = self._known.shorter_half()
        found: list[np.ndarray | None] = [None] * len(texts)
        split = [i for i, text in enumerate(texts) if self._in_chunks(text)]
        raw = [texts[i].encode() for i in split]
        odd = [len(t) != len(t.translate(None, _ODD)) for t in raw]
        split, raw = ([x for x, other in zip(xs, odd) if not other] for xs in (split, raw))
        whole = sorted(set(range(len(texts))) - set(split))
        for i, ids in zip(whole, self._plain([texts[i] for i in whole])):
            found[i] = ids
        data = b"".join(raw)
        buffer = np.frombuffer(data + bytes(16), np.uint8)
        ends = np.cumsum(np.array([len(t) for t in raw], np.int64))
        starts = _starts(buffer[: len(data)], np.r_[0, ends[:-1]]) if data else np.zeros(0, np.int64)
        ids, counts = self._known.ids_of(self._entries(data, buffer, starts))
        reached = np.r_[0, np.cumsum(counts)][np.searchsorted(starts, ends)].tolist()
        for i, a, b in zip(split, [0, *reached], reached):
            found[i] = ids[a:b]
        return found

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """For each text an array (tokens, 2) of a token's first character and the one after its last; tokens that
        share a character all span it."""
        if not self.chunked:
            return [np.array(e.offsets, np.int64).reshape(-1, 2) for e in self._whole(texts)]
        found = []
        for text, ids in zip(texts, self.ids(texts)):
            if self._has_added(text):
                found.append(np.array(self._whole([text])[0].offsets, np.int64).reshape(-1, 2))
                continue
            ends = np.cumsum(self._bytes[ids])
            spans = np.stack([ends - self._bytes[ids], ends], axis=1)
            if not text.isascii() and len(ids):
                heads = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
                place = np.cumsum(heads) - 1
                spans = np.stack([place[spans[:, 0]], place[spans[:, 1] - 1] + 1], axis=1)
            found.append(spans)
        return found


class TokenizerFile:
    """A tokenizer's definition, read once on the driver and sent to the tasks."""

    def __init__(self, path: str):
        context = SparkContext.getOrCreate()
        with open(path, encoding="utf-8") as f:
            self._definition = context.broadcast(f.read())

    def encoder(self) -> Encoder:
        definition = self._definition.value
        key = crc32(definition.encode())
        if key not in _LOADED:
            _LOADED[key] = Encoder(definition)
        return _LOADED[key]
