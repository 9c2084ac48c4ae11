"""Range coder for blocks of token ids over an escape cascade of contexts, many blocks side by side.

Every block starts from a fresh model, so blocks can be coded in lock step: a step codes one id of each block with numpy operations over
all of them. The model of a block predicts an id from the last two ids and from the last one (hashed tables with a confidence of 0 to 3 each)
and keeps an order-0 distribution of the ids' upper bytes. Whether the order-2 or else the order-1 prediction holds is one decision among three, with
adaptive probabilities chosen by both confidences and by whether the predictions agree; an id that neither predicts is coded by its upper byte and, evenly,
its lower byte. The order-0 distribution follows the counts of the upper bytes that the block has coded so and is drawn up anew at the steps in DRAWN.
The coder has 64 bits, gives out words of 32 and carries into words given out before.

Ids are below 65536, larger ones raise an error. Blocks may differ in length; an empty block has no bytes.
"""

from __future__ import annotations

import numpy as np

SLOTS_1, SLOTS_2 = 10, 11
NONE = 65535
#: Steps at which a block's order-0 distribution is drawn up from its counts; from the last on every so many steps.
DRAWN, LATER = (8, 16, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768), 512
#: What an upper byte counts before it is seen.
UNSEEN = 0.1
_U = np.uint64
_K1, _K2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_WORD, _TWELVE, _TWENTY, _NOUGHT, _LEAST = _U(32), _U(12), _U(20), _U(0), _U(1 << 32)


class _Model:
    """Tables of m blocks, kept flat so that one take reads a value of each. An entry of `ids` is 4 * id + confidence, order 1 before order 2."""

    def __init__(self, m: int, searched: bool):
        lane = np.arange(m, dtype=np.int64)
        self.base1, self.base2 = lane << SLOTS_1, (lane << SLOTS_2) + (m << SLOTS_1)
        self.ids = np.full((m << SLOTS_1) + (m << SLOTS_2), 4 * NONE, np.uint32)
        self.lane32, self.lane256, self.lane4096 = (lane << 5).astype(np.int32), lane << 8, lane << 12
        self.hit = np.full(m << 5, (1 << 14) | (1 << 13 << 16), np.uint32)  # order 2 in the lower 16 bits, order 1 above
        self.counts = np.zeros(m << 8, np.uint32)
        #: Share of 4096 of every upper byte (below) and the shares before it (above); the upper byte at each of the 4096.
        self.shares = np.tile((np.arange(256, dtype=np.uint32) << 20) | 16, m)
        self.slots = np.tile(np.arange(4096, dtype=np.uint16) >> 4, m).astype(np.uint8) if searched else None

    def draw(self, n: int) -> None:
        """Order-0 distributions of the first n blocks from their counts."""
        counts = self.counts[: n << 8].reshape(n, 256)
        total = counts.sum(axis=1).astype(np.float32) + np.float32(256 * UNSEEN)
        share = ((counts.astype(np.float32) + np.float32(UNSEEN)) * (np.float32(3839) / total)[:, None]).astype(np.uint16) + np.uint16(1)
        most = counts.argmax(axis=1)
        share[np.arange(n), most] += (4096 - share.sum(axis=1, dtype=np.int64)).astype(np.uint16)
        ends = share.cumsum(axis=1, dtype=np.uint32)
        self.shares[: n << 8] = (((ends - share) << np.uint32(16)) | share).ravel()
        if self.slots is not None:
            self.slots[: n << 12] = np.repeat(np.tile(np.arange(256, dtype=np.uint8), n), share.ravel())

    def look(self, n: int, last: np.ndarray, before: np.ndarray) -> None:
        """Predictions for the next id of the first n blocks, given the hashes of their last two ids."""
        self.at = np.empty((2, n), np.int64)
        np.add((last >> _U(64 - SLOTS_1)).view(np.int64), self.base1[:n], out=self.at[0])
        np.add(((last + before * _K2) >> _U(64 - SLOTS_2)).view(np.int64), self.base2[:n], out=self.at[1])
        self.entry = self.ids.take(self.at)
        self.guess, self.conf = self.entry >> 2, self.entry & 3
        context = (self.conf[1] << 3) | (self.conf[0] << 1) | (self.guess[0] == self.guess[1])
        self.where = self.lane32[:n] + context.view(np.int32)
        both = self.hit.take(self.where)
        self.q2, self.q1 = (both & 65535).view(np.int32), (both >> 16).view(np.int32)
        end2 = self.q2 >> 4
        self.end2, self.end12 = end2.astype(_U), (end2 + np.maximum(((4096 - end2) * (self.q1 >> 4)) >> 12, 1)).astype(_U)

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit12: np.ndarray) -> None:
        q2 = self.q2 + ((hit2 * np.int32(65488) + 32 - self.q2) >> 4)
        q1 = self.q1 + ((hit12 * np.int32(65488) + 32 - self.q1) >> 4) * ~hit2
        self.hit[self.where] = (q2 | (q1 << 16)).view(np.uint32)
        kept = np.where(self.conf > 1, self.entry - 1, (ids << 2) | 1)
        self.ids[self.at] = np.where(self.guess == ids, self.entry + (self.conf < 3), kept)


class _Encoder:
    """`low` is the low end of each span; a carry goes into the words given out before."""

    def __init__(self, m: int, steps: int):
        self.low, self.span = np.zeros(m, _U), np.full(m, (1 << 64) - 1, _U)
        self.width = steps + 4  # a step takes 32 bits at most
        self.data, self.place = np.zeros(m * self.width, np.uint32), np.arange(m) * self.width

    def step(self, model: _Model, ids: np.ndarray) -> np.ndarray:
        n, span, low = len(ids), self.span[: len(ids)], self.low[: len(ids)]
        hit2 = model.guess[1] == ids
        hit12 = hit2 | (model.guess[0] == ids)
        part = span >> _TWELVE
        t2, t12 = part * model.end2, part * model.end12
        start = np.where(hit12, np.where(hit2, _NOUGHT, t2), t12)
        size = np.where(hit12, np.where(hit2, t2, t12), span) - start
        miss = (~hit12).nonzero()[0]
        value = ids.take(miss)
        at = model.lane256.take(miss) + (value >> 8)
        model.counts[at] += 1
        shares = model.shares.take(at)
        share = shares & 65535
        part = size.take(miss) >> _TWENTY
        start[miss] = start.take(miss) + part * (((shares >> 16) << 8) + (value & 255) * share)
        size[miss] = part * share
        new = low + start
        over = new < low
        if over.any():
            self.carry(over.nonzero()[0])
        self.low[:n] = new
        self.span[:n] = size
        self.shift((size < _LEAST).nonzero()[0])
        model.learn(ids, hit2, hit12)
        return ids

    def carry(self, lanes: np.ndarray) -> None:
        at = self.place[lanes]
        while len(at):
            at = at - 1
            self.data[at] += 1
            at = at[self.data[at] == 0]

    def shift(self, lanes: np.ndarray) -> None:
        """Give out a word of some blocks."""
        at, low = self.place.take(lanes), self.low.take(lanes)
        self.data[at] = low >> _WORD
        self.place[lanes] = at + 1
        self.low[lanes] = low << _WORD
        self.span[lanes] = self.span.take(lanes) << _WORD

    def finish(self) -> list[bytes]:
        low = self.low + _U((1 << 32) - 1)
        self.carry((low < self.low).nonzero()[0])
        self.low = low
        self.shift(np.arange(len(low)))
        return [self.data[i * self.width : end].astype(">u4").tobytes() for i, end in enumerate(self.place.tolist())]


class _Decoder:
    """`off` is how far the code lies above the low end of each span."""

    def __init__(self, payloads: list[bytes]):
        self.data = np.frombuffer(b"".join(p + bytes(8) for p in payloads), ">u4").astype(np.uint32)
        sizes = np.array([len(p) // 4 + 2 for p in payloads], dtype=np.int64)
        self.place = np.cumsum(sizes) - sizes + 2
        self.off = (self.data[self.place - 2].astype(_U) << _WORD) | self.data[self.place - 1]
        self.span = np.full(len(payloads), (1 << 64) - 1, _U)

    def step(self, model: _Model, ids: np.ndarray) -> np.ndarray:
        n, span, off = len(ids), self.span[: len(ids)], self.off[: len(ids)]
        part = span >> _TWELVE
        t2, t12 = part * model.end2, part * model.end12
        hit2, hit12 = off < t2, off < t12
        start = np.where(hit12, np.where(hit2, _NOUGHT, t2), t12)
        size = np.where(hit12, np.where(hit2, t2, t12), span) - start
        off = off - start
        ids = np.where(hit2, model.guess[1], model.guess[0])
        miss = (~hit12).nonzero()[0]
        part, left = size.take(miss) >> _TWENTY, off.take(miss)
        below = np.minimum(left // part, _U((1 << 20) - 1)).astype(np.uint32)
        upper = model.slots.take(model.lane4096.take(miss) + (below >> 8))
        at = model.lane256.take(miss) + upper
        model.counts[at] += 1
        shares = model.shares.take(at)
        share, begin = shares & 65535, (shares >> 16) << 8
        lower = (below - begin) // share
        off[miss] = left - part * (begin + lower * share)
        size[miss] = part * share
        ids[miss] = (upper.astype(np.uint32) << 8) | lower
        self.off[:n] = off
        self.span[:n] = size
        self.shift((size < _LEAST).nonzero()[0])
        model.learn(ids, hit2, hit12)
        return ids

    def shift(self, lanes: np.ndarray) -> None:
        at = self.place.take(lanes)
        self.off[lanes] = (self.off.take(lanes) << _WORD) | self.data.take(at, mode="clip")
        self.place[lanes] = at + 1
        self.span[lanes] = self.span.take(lanes) << _WORD


def _lock_step(coder: _Encoder | _Decoder, lengths: np.ndarray, table: np.ndarray) -> None:
    """Code the columns of `table`, the longest first, or fill them."""
    steps, m = table.shape
    model = _Model(m, isinstance(coder, _Decoder))
    last, before = np.zeros(m, _U), np.zeros(m, _U)
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # blocks longer than the step
    for t in range(steps):
        n = int(live[t])
        if t in DRAWN or t > DRAWN[-1] and not t % LATER:
            model.draw(n)
        model.look(n, last[:n], before[:n])
        table[t, :n] = ids = coder.step(model, table[t, :n])
        before, last = last, ids * _K1


def _by_size(sizes: np.ndarray) -> np.ndarray:
    """Places of the blocks that are not empty, the longest first."""
    return np.argsort(-sizes, kind="stable")[: int((sizes > 0).sum())]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Bytes of every block of ids."""
    sizes = np.array([len(b) for b in blocks], dtype=np.int64)
    out: list[bytes] = [b""] * len(blocks)
    order = _by_size(sizes)
    if not len(order):
        return out
    table = np.zeros((int(sizes[order[0]]), len(order)), np.uint32)
    for lane, i in enumerate(order):
        table[: sizes[i], lane] = blocks[i]
    if table.max() > NONE:
        raise ValueError(f"token ids must be below {NONE + 1}, found {table.max()}")
    coder = _Encoder(len(order), len(table))
    _lock_step(coder, sizes[order], table)
    for i, body in zip(order, coder.finish(), strict=True):
        out[i] = body
    return out


def decode(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """Ids (uint32) of every block."""
    size = np.array(sizes, dtype=np.int64)
    out = [np.zeros(0, np.uint32)] * len(payloads)
    order = _by_size(size)
    if not len(order):
        return out
    table = np.zeros((int(size[order[0]]), len(order)), np.uint32)
    _lock_step(_Decoder([payloads[i] for i in order]), size[order], table)
    for lane, i in enumerate(order):
        out[i] = table[: size[i], lane].copy()
    return out
