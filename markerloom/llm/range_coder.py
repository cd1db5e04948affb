"""Adaptive context-mixing range coder for token ids, in blocks that start from nothing.

Every block has its own model. Order 2 and order 1 each predict one id, the last one seen in a hashed context; order 0 gives
every id a probability through adaptive frequencies of id classes. The distribution of the next id is the mixture of the three,

    P(id) = w2 [id = prediction 2] + w1 [id = prediction 1] + (the rest) P0(id),

where the weights w are adaptive hit rates for each state: how many ids before were predicted, whether order 2 predicts, whether
both agree. Predictions change with every id; weights follow what was seen, and frequencies the ids that order 0 coded, at the end
of each window. The mixture drives a carry-less range coder with 64-bit state and 32-bit output words, in one step for each id.
All arithmetic is on integers, or on numbers that are exact in doubles, so any machine decodes what another has written.

Blocks are coded side by side: step t codes the t-th id of all blocks with one sequence of array operations. Encoder and decoder
run the same steps and differ only in whether the id is given or looked up.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np

BLOCK = 2048
# Ids must be below this; classes of ids have sizes that are powers of two.
MAX_ID = (1 << 16) - 4
# Bits of a weight, of a class's frequency, and of a place in a class: together a step's share.
MIX_BITS, CLASS_BITS, ID_BITS = 8, 10, 13
# Contexts per order and block, as a power of two.
ORDER = 8
# Steps of a window, and steps after which it ends early.
WINDOW, EARLY = 512, (16, 64, 128, 256)
# Uses of a state after which its counts are halved.
_FULL = 255
# Blocks turned into columns at once.
_TURNED = 16

_U, _I = np.uint64, np.uint32
_LOW32, _32 = _U(0xFFFFFFFF), _U(32)
_NARROW = _U(1 << 32)
_PLAIN, _TOTAL = _I(CLASS_BITS + ID_BITS), _U(MIX_BITS + CLASS_BITS + ID_BITS)
# In a table of predictions: none.
_NONE = (1 << 16) - 1


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every id, first id of every class, and bits of the offset: four classes per power of two of id + 4."""
    x = np.arange(MAX_ID) + 4
    power = np.frexp(x.astype(np.float64))[1] - 1
    of = ((power - 2) * 4 + (x >> np.maximum(power - 2, 0)) - 4).astype(np.int64)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    sizes = np.diff(np.r_[first, MAX_ID])
    return of, first, np.ceil(np.log2(sizes)).astype(np.int64)


CLASS_OF, CLASS_START, CLASS_OFFSET_BITS = _classes()
N_CLASSES = len(CLASS_START)
_START = CLASS_START.astype(_I)
# Class of every id, and its place there above.
_PLACES = (CLASS_OF | (np.arange(MAX_ID) - CLASS_START[CLASS_OF]) << 8).astype(_I)

# States: up to three ids predicted before, whether order 2 predicts, and whether both predict the same.
STATES = 16
_RUN, _HAS, _SAME = np.arange(STATES) >> 2, np.arange(STATES) >> 1 & 1, np.arange(STATES) & 1
# What is counted before anything was seen: none was right, order 2 was, only order 1 was.
_BEFORE = np.stack([np.full(STATES, 12), _HAS * (1 + _SAME) * (1 + 2 * _RUN), (1 - _SAME) * (1 + _RUN)]).astype(np.int32)


class _Model:
    """State of `lanes` blocks at the same step. Axis 0 of the paired arrays is order 2, then order 1."""

    def __init__(self, lanes: int, lookup: bool):
        self.lanes, self.lookup = lanes, lookup
        # One flat table: contexts of order 2 of all lanes, then those of order 1.
        self.table = np.full(lanes << (ORDER + 1), _NONE, np.uint16)
        self.at = np.arange(2 * lanes).reshape(2, lanes) << ORDER
        self.table_at = self.at.copy()
        self.guess, self.mixed, self.run = np.empty((2, lanes), np.uint16), np.zeros(lanes, _I), np.zeros(lanes, np.uint8)
        lane = np.arange(lanes)
        self.state_at, self.log_at = lane * STATES, lane * (3 * STATES)
        self.class_at, self.count_at, self.slot_at = lane * N_CLASSES, lane * (N_CLASSES + 1), lane << CLASS_BITS
        self.seen = np.tile(_BEFORE, (lanes, 1, 1))
        # The last one counts ids that order 0 has not coded, and is not used.
        self.counts = np.ones((lanes, N_CLASSES + 1))
        self.log, self.class_log = np.zeros((2, WINDOW, lanes), np.uint8)
        self.logged = 0
        self._follow()

    def _follow(self) -> None:
        """The weights and frequencies of the next window."""
        if self.logged:
            at = self.log[: self.logged] + self.log_at
            self.seen += np.bincount(at.ravel(), minlength=self.seen.size).reshape(self.seen.shape).astype(np.int32)
            self.seen >>= (self.seen[:, :1] + self.seen[:, 1:2] + self.seen[:, 2:] > _FULL).view(np.uint8)
            np.add(self.class_log[: self.logged], self.count_at, out=at)
            self.counts += 24.0 * np.bincount(at.ravel(), minlength=self.counts.size).reshape(self.counts.shape)
            self.logged = 0
        # Weights leave order 0 some share, and have some where a prediction can be right.
        none, two, one = self.seen[:, 0], self.seen[:, 1], self.seen[:, 2]
        uses, most = none + two + one, (1 << MIX_BITS) - 4
        two = (two * most / uses).astype(_I) + _HAS.astype(_I)
        one = (one * most / uses).astype(_I) + (1 - _SAME).astype(_I)
        # A state's share of order 0, and that of order 2 above.
        self.shares = ((1 << MIX_BITS) - two - one | two << _I(16)).reshape(-1)
        total = np.cumsum(self.counts[:, :-1], axis=1)
        total *= (1 << CLASS_BITS) - N_CLASSES
        total /= total[:, -1:] / ((1 << CLASS_BITS) - N_CLASSES)
        ends = total.astype(np.int64)
        ends += np.arange(1, N_CLASSES + 1)
        sizes = np.diff(ends, axis=1, prepend=0)
        # Where a class begins, and the share of each of its ids above.
        units = sizes << (32 + ID_BITS - CLASS_OFFSET_BITS)
        ends -= sizes
        ends <<= ID_BITS
        units |= ends
        self.units = units.reshape(-1)
        if self.lookup:
            self.slots = np.repeat(np.tile(np.arange(N_CLASSES, dtype=np.uint8), self.lanes), sizes.ravel())

    def predict(self) -> None:
        """The two predicted ids, the share of order 0 in 2**MIX_BITS, and where it ends in a step's share."""
        self.table.take(self.at, out=self.guess, mode="clip")
        state = (self.guess[0] != _NONE).view(np.uint8) << 1
        state |= self.guess[0] == self.guess[1]
        state |= self.run
        self.state = state
        self.share = self.shares.take(state + self.state_at, mode="clip")
        self.rest = self.share & _I(0xFFFF)
        self.limit = self.rest << _PLAIN

    def plain(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and share of an id of these classes in order 0."""
        units = self.units.take(classes + self.class_at, mode="clip")
        return units.astype(_I), (units >> 32).astype(_I)

    def predicted(self, start: np.ndarray, size: np.ndarray, by: np.ndarray, two: np.ndarray, is_2: np.ndarray) -> None:
        """Put the intervals of predicted ids where those of order 0 are, in the lanes `by`: that of order 2, whose size is `two`,
        lies behind order 0, then comes that of order 1."""
        begin = self.limit[by]
        left = _I(1 << int(_TOTAL)) - begin - two
        size[by] = np.where(is_2, two, left)
        two[is_2] = 0
        start[by] = begin + two

    def update(self, now: np.ndarray, classes: np.ndarray, by: np.ndarray, is_2: np.ndarray, step: int, steps: int) -> None:
        """The ids of this step, their classes, the lanes where a prediction was right, and where that was order 2."""
        log, class_log = self.log[self.logged], self.class_log[self.logged]
        log[:], class_log[:] = self.state, classes
        log[by] += np.uint8(2 * STATES) - is_2 * np.uint8(STATES)
        class_log[by] = N_CLASSES
        run = np.minimum(self.run[by] + 4, 12)
        self.run = np.zeros(self.lanes, np.uint8)
        self.run[by] = run
        self.table[self.at] = now
        mixed = now.astype(_I)
        mixed *= _I(0x9E3779B1)
        self.mixed += mixed
        np.right_shift(self.mixed, _I(32 - ORDER), out=self.at[0], casting="unsafe")
        np.right_shift(mixed, _I(32 - ORDER), out=self.at[1], casting="unsafe")
        self.at += self.table_at
        mixed *= _I(0xC2B2AE35)
        self.mixed = mixed
        self.logged += 1
        if step + 1 < steps and ((step + 1) % WINDOW == 0 or step + 1 in EARLY):
            self._follow()


def _narrowed(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """What is left of narrow spans before their first word goes: none reaches over a change of that word."""
    last = low + span
    last -= _U(1)
    last ^= low
    crosses = (last > _LOW32).nonzero()[0]
    span[crosses] = (~low[crosses] + _U(1)) & _LOW32
    return span


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The payload of every block. Blocks must not grow in length along the list."""
    if not blocks:
        return []
    lanes, sizes = len(blocks), [len(b) for b in blocks]
    if max(int(b.max(initial=0)) for b in blocks) >= MAX_ID:
        raise ValueError(f"ids must be below {MAX_ID}")
    # Lanes that have ended go on with zeros, which nobody reads.
    ids = np.zeros((sizes[0], lanes), np.uint16)
    for i in range(0, lanes, _TURNED):
        some = blocks[i : i + _TURNED]
        if len(some[-1]) == sizes[0]:
            ids[:, i : i + len(some)] = np.stack(some, axis=1)
        else:
            for k, b in enumerate(some):
                ids[: len(b), i + k] = b
    model = _Model(lanes, lookup=False)
    low, span, active = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U), lanes
    # The words of all lanes side by side, the place of the next one, and the last two of each lane. A step writes one word at most,
    # and seldom needs as much.
    words, at, tails = np.zeros((max(64, sizes[0] // 2 + 64), lanes), "<u4"), np.arange(lanes), np.zeros(lanes, _U)

    for step in range(sizes[0]):
        if sizes[active - 1] <= step:
            ended, active = active, next(i for i in range(active, 0, -1) if sizes[i - 1] > step)
            tails[active:ended] = low[active:ended]
        now = ids[step]
        model.predict()
        hit = model.guess == now
        by = (hit[0] | hit[1]).nonzero()[0]
        is_2 = hit[0][by]
        place = _PLACES.take(now)
        classes = place.astype(np.uint8)
        place >>= _I(8)
        start, size = model.plain(classes)
        place *= size
        start += place
        start *= model.rest
        size *= model.rest
        model.predicted(start, size, by, (model.share[by] >> _I(16)) << _PLAIN, is_2)
        span >>= _TOTAL
        low += start * span
        span *= size
        narrow = (span[:active] < _NARROW).nonzero()[0]
        if len(narrow):
            begin = low[narrow]
            width = _narrowed(begin, span[narrow])
            place = at[narrow]
            if step >= len(words) - 4 and place.max() // lanes >= len(words) - 4:
                words = np.concatenate([words, np.zeros_like(words)])
            words.reshape(-1)[place] = begin >> _32
            at[narrow] = place + lanes
            low[narrow], span[narrow] = begin << _32, width << _32
        model.update(now, classes, by, is_2, step, sizes[0])
    tails[:active] = low[:active]
    words.reshape(-1)[at] = tails >> _32
    words.reshape(-1)[at + lanes] = tails & _LOW32
    counts = (at // lanes + 2).tolist()
    columns = (c for i in range(0, lanes, _TURNED) for c in np.ascontiguousarray(words[:, i : i + _TURNED].T))
    return [c[:n].tobytes() for c, n in zip(columns, counts)]


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b of 32-bit numbers, where doubles are exact."""
    return (a / b).astype(_I)


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of every block. Sizes must not grow along the list."""
    if not payloads:
        return []
    lanes, steps = len(payloads), int(sizes[0])
    model = _Model(lanes, lookup=True)
    longest = max(len(p) for p in payloads) // 4 + 4
    words = np.zeros((lanes, longest), np.uint32)
    for i, p in enumerate(payloads):
        words[i, : len(p) // 4] = np.frombuffer(p, "<u4")
    code = (words[:, 0].astype(_U) << _32) | words[:, 1].astype(_U)
    words, at = words.reshape(-1), np.arange(lanes) * longest + 2
    low, span = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U)
    ids = np.zeros((steps, lanes), np.uint16)

    # A damaged block and one that has ended may lead anywhere, so places are clipped; its checksum tells.
    with np.errstate(divide="ignore"):
        for step in range(steps):
            model.predict()
            span >>= _TOTAL
            value = code - low
            value //= span
            value = value.astype(_I)
            by = (value >= model.limit).nonzero()[0]
            # The place in order 0, of which each has `rest` values.
            place = _quotient(value, model.rest)
            classes = model.slots.take((place >> _I(ID_BITS)) + model.slot_at, mode="clip")
            start, size = model.plain(classes)
            place -= start
            offset = _quotient(place, size)
            now = ids[step]
            np.add(_START.take(classes), offset, out=now, casting="unsafe")
            offset *= size
            start += offset
            start *= model.rest
            size *= model.rest
            two = (model.share[by] >> _I(16)) << _PLAIN
            is_2 = value[by] - model.limit[by] < two
            model.predicted(start, size, by, two, is_2)
            now[by] = np.where(is_2, model.guess[0][by], model.guess[1][by])
            low += start * span
            span *= size
            narrow = (span < _NARROW).nonzero()[0]
            if len(narrow):
                begin, from_ = low[narrow], at[narrow]
                width = _narrowed(begin, span[narrow])
                low[narrow], span[narrow] = begin << _32, width << _32
                code[narrow] = (code[narrow] << _32) | words.take(from_, mode="clip")
                at[narrow] = from_ + 1
            model.update(now, classes, by, is_2, step, steps)
    columns = (c for i in range(0, lanes, _TURNED) for c in ids[:, i : i + _TURNED].T.astype(np.uint32, order="C"))
    return [c[:n] for c, n in zip(columns, sizes)]


def cut(ids: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    return [ids[i : i + block] for i in range(0, len(ids), block)]


def checksum(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit integers."""
    return crc32(ids.astype("<u4", copy=False).tobytes())
