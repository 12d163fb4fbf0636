"""Word shingle sets of whole texts as sorted arrays of 64-bit hashes, vectorised over batches."""

from __future__ import annotations

import numpy as np

WORDS = 5
PIECE_BYTES = 1 << 19
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RADIX = pow(0x9E3779B97F4A7C15, 1, 1 << 64) | 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(radix: int, n: int) -> np.ndarray:
    steps = np.full(n, radix, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_POW, _INV = _powers(_RADIX, PIECE_BYTES + 1), _powers(pow(_RADIX, -1, 1 << 64), PIECE_BYTES + 1)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of `data`, A-Z read as a-z."""
    b = np.frombuffer(data, np.uint8)
    white = _WHITE[b]
    first = ~white
    first[1:] &= white[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    value = _BYTE[_LOWER[b]]
    value[white] = 0
    power, inverse = (_POW, _INV) if len(b) <= PIECE_BYTES else (_powers(_RADIX, len(b)), _powers(pow(_RADIX, -1, 1 << 64), len(b)))
    sums = np.add.reduceat(value * power[: len(b)], starts)
    return mix(sums * inverse[starts]), starts


def _pieces(text: bytes):
    """Cuts of a long text at white space, each of PIECE_BYTES or one longer word."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        if end < len(text):
            cut = max(text.rfind(bytes([c]), at, end) for c in b" \t\n\x0b\x0c\r")
            if cut < 0:
                found = [p for c in b" \t\n\x0b\x0c\r" if (p := text.find(bytes([c]), end)) >= 0]
                cut = min(found, default=len(text) - 1)
            end = cut + 1
        yield text[at:end]
        at = end


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a whole text in order, A-Z read as a-z."""
    return np.concatenate([np.zeros(0, np.uint64), *(_word_hashes(p)[0] for p in _pieces(text.encode("utf-8", "surrogatepass")))])


def _windows(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of WORDS words."""
    n = len(words) - WORDS + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(WORDS):
        total += words[k : k + len(total)] * np.uint64(2 * (k * k + 11 * k + 3) * 0x1F123BB5 + 1)
    return mix(total, WORDS)


def _short(words: np.ndarray) -> np.ndarray:
    """The whole sequence as one shingle, told apart by its number of words."""
    if not len(words):
        return words
    h = np.zeros(1, np.uint64)
    for w in words:
        h = mix(h * np.uint64(3) + w, len(words))
    return h


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; empty for a text without words."""
    out: list[np.ndarray | None] = [None] * len(texts)
    held: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        words, starts = _word_hashes(b" ".join(texts[i] for i in held))
        ends = np.cumsum([len(texts[i]) + 1 for i in held])
        last = np.searchsorted(starts, ends)
        windows = _windows(words)
        for i, a, b in zip(held, np.concatenate([[0], last[:-1]]), last, strict=True):
            out[i] = np.unique(windows[a : b - WORDS + 1]) if b - a >= WORDS else _short(words[a:b])
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        if len(text) >= PIECE_BYTES:
            words = np.concatenate([_word_hashes(p)[0] for p in _pieces(text)])
            out[i] = np.unique(_windows(words)) if len(words) >= WORDS else _short(words)
            continue
        if size + len(text) + 1 > PIECE_BYTES and held:
            flush()
        held.append(i)
        size += len(text) + 1
    if held:
        flush()
    return out
