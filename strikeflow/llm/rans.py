"""Static range asymmetric numeral system over token ids, in numpy.

One frequency table, of sum 2**TABLE_BITS, serves all blocks.  A block holds
up to BLOCK tokens dealt in turn to LANES interleaved coders with a 64-bit
state each; the coders' 32-bit words share one stream in decoding order.  A
checkpoint every STRIDE steps holds the lanes' states and the place in the
stream, so that each stretch of a block decodes by itself; all stretches of
all blocks of a record decode side by side.

A block's bytes, little-endian: header of four uint32 (tokens, checkpoints,
words, CRC-32 of all that follows), the checkpoints' places (uint32 each) and
states (LANES uint64 each), the words (uint32).
"""

from __future__ import annotations

import zlib

import numpy as np

TABLE_BITS = 20
LANES = 128
STRIDE = 128
BLOCK = 4 * STRIDE * LANES
_LOW = np.uint64(1 << 31)


def quantise(counts: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """Frequencies of sum ``2**bits`` in proportion to ``counts``, one at least where a count is above zero."""
    counts = np.asarray(counts, dtype=np.float64)
    used = np.flatnonzero(counts)
    freq = np.zeros(len(counts), dtype=np.int64)
    if not len(used):
        return freq
    if len(used) > 1 << bits:
        raise ValueError("more symbols than table entries")
    share = counts[used] / counts[used].sum()
    freq[used] = np.maximum(1, np.floor(share * (1 << bits)).astype(np.int64))
    order = used[np.argsort(-freq[used], kind="stable")]
    left = (1 << bits) - freq.sum()
    if left >= 0:
        freq[order[0]] += left
    for i in order:  # the largest give what rounding up has taken
        if left >= 0:
            break
        give = min(freq[i] - 1, -left)
        freq[i] -= give
        left += give
    return freq


class Table:
    """Frequencies with their running sums, and the symbol at each place."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, dtype=np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), np.asarray(freq, dtype=np.int64))
        self.pad = int(np.argmax(freq)) if len(freq) else 0


def _encode(table: Table, tokens: np.ndarray) -> list[bytes]:
    """Blocks of equal length, one per row of ``tokens`` (blocks, steps * LANES)."""
    blocks, steps = len(tokens), tokens.shape[1] // LANES
    grid = tokens.reshape(blocks, steps, LANES)
    freq, start = table.freq[grid], table.start[grid]
    limit = freq << np.uint64(63 - TABLE_BITS)
    state = np.full((blocks, LANES), _LOW)
    words = np.zeros((steps, blocks, LANES), dtype=np.uint32)
    out = np.zeros((steps, blocks, LANES), dtype=bool)
    marks = {}
    for t in range(steps - 1, -1, -1):
        f = freq[:, t]
        over = state >= limit[:, t]
        out[t], words[t] = over, state.astype(np.uint32)
        state = np.where(over, state >> np.uint64(32), state)
        whole = state // f
        state = (whole << np.uint64(TABLE_BITS)) + (state - whole * f) + start[:, t]
        if t % STRIDE == 0:
            marks[t] = state
    return [_pack(words[:, b], out[:, b], [marks[t][b] for t in sorted(marks)]) for b in range(blocks)]


def _pack(words: np.ndarray, out: np.ndarray, marks: list[np.ndarray]) -> bytes:
    before = np.concatenate([[0], np.cumsum(out.sum(axis=1))])
    places = before[[i * STRIDE for i in range(len(marks))]].astype("<u4")
    return places.tobytes() + np.stack(marks).astype("<u8").tobytes() + words[out].astype("<u4").tobytes()


def encode(table: Table, tokens: np.ndarray) -> list[bytes]:
    """The blocks of a token sequence; no tokens give no block."""
    full = len(tokens) // BLOCK
    bodies, sizes = [], [BLOCK] * full
    for i in range(0, full, 16):
        bodies += _encode(table, tokens[i * BLOCK : min(full, i + 16) * BLOCK].reshape(-1, BLOCK))
    rest = tokens[full * BLOCK :]
    if len(rest):
        padded = np.full(-(-len(rest) // LANES) * LANES, table.pad, dtype=tokens.dtype)
        padded[: len(rest)] = rest
        bodies += _encode(table, padded[None])
        sizes.append(len(rest))
    blocks = []
    for body, n in zip(bodies, sizes):
        marks = -(-n // (LANES * STRIDE))
        words = (len(body) - marks * (4 + 8 * LANES)) // 4
        blocks.append(np.array([n, marks, words, zlib.crc32(body)], dtype="<u4").tobytes() + body)
    return blocks


def decode(table: Table, blocks: list[bytes]) -> np.ndarray:
    """The tokens of the blocks, in order; raises ValueError if a checksum doesn't fit."""
    states, places, streams, want = [], [], [], []
    base = 0
    for block in blocks:
        n, marks, words, crc = (int(x) for x in np.frombuffer(block, "<u4", 4))
        if zlib.crc32(memoryview(block)[16:]) != crc:
            raise ValueError("a block of token ids is damaged")
        at = 16 + 4 * marks
        places.append(np.frombuffer(block, "<u4", marks, 16).astype(np.int64) + base)
        states.append(np.frombuffer(block, "<u8", marks * LANES, at).reshape(marks, LANES))
        streams.append(np.frombuffer(block, "<u4", words, at + 8 * LANES * marks))
        want += [min(LANES * STRIDE, n - i * LANES * STRIDE) for i in range(marks)]
        base += words
    if not blocks:
        return np.zeros(0, dtype=np.uint32)
    # a stretch that ends early reads on into what follows; its surplus is cut off below
    stream = np.concatenate([*streams, np.zeros(LANES * STRIDE, dtype=np.uint32)])
    out = [_decode(table, s, p, stream) for s, p in zip(_parts(np.concatenate(states)), _parts(np.concatenate(places)))]
    tokens = np.concatenate(out).reshape(len(want), -1)
    keep = np.arange(tokens.shape[1]) < np.array(want)[:, None]
    return tokens[keep]


def _parts(a: np.ndarray, n: int = 256) -> list[np.ndarray]:
    return [a[i : i + n] for i in range(0, len(a), n)]


def _decode(table: Table, state: np.ndarray, place: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """STRIDE steps of all stretches at once: (stretches, STRIDE * LANES)."""
    tokens = np.zeros((len(state), STRIDE, LANES), dtype=np.uint32)
    state, place = state.copy(), place.copy()
    mask, bits, last = np.uint64((1 << TABLE_BITS) - 1), np.uint64(TABLE_BITS), len(stream) - 1
    for t in range(STRIDE):
        low = state & mask
        symbol = table.symbol[low]
        tokens[:, t] = symbol
        state = table.freq[symbol] * (state >> bits) + low - table.start[symbol]
        need = state < _LOW
        index = np.minimum(place[:, None] + np.cumsum(need, axis=1) - 1, last)
        state = np.where(need, (state << np.uint64(32)) | stream[np.maximum(index, 0)], state)
        place += need.sum(axis=1)
    return tokens.reshape(len(state), -1)
