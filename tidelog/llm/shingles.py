"""Sets of hashed word shingles of whole texts, and a bounded count of how common each shingle is."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: A sketch's rows; a shingle's count is the least of its counters, one a row.
SKETCH_ROWS = 2

_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(20240131)
#: Fixed random values of the bytes, and an odd base, of the rolling hash modulo 2^64.
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BASE = int(_rng.integers(0, 1 << 62)) * 4 + 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """Powers of the base and of its inverse up to n, kept for the process."""
    global _powers, _inverses
    with np.errstate(over="ignore"):
        while len(_powers) < n:
            size = len(_powers)
            _powers = np.concatenate([_powers, _powers * np.uint64(pow(_BASE, size, 1 << 64))])
            _inverses = np.concatenate([_inverses, _inverses * np.uint64(pow(_INVERSE, size, 1 << 64))])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles: of all its words if they are fewer, none without words.

    Words are what lies between white space (space, tab to carriage return), A-Z lower-cased; a shingle is its
    words between single spaces, hashed as bytes.
    """
    plain = b" ".join(text.translate(_UPPER).split()) if text else b""
    if not plain:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(plain, np.uint8)
    _grow(len(raw) + 1)
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(raw)]))
    k = min(words, len(starts))
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _powers[: len(raw)], out=sums[1:])
        hashed = (sums[ends] - sums[starts]) * _inverses[starts]
    return np.unique(mix(hashed))


def set_id(shingle_set: np.ndarray) -> int:
    """A signed 64-bit number of a set; two different sets have the same one with probability 2^-64."""
    with np.errstate(over="ignore"):
        total = mix(shingle_set ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + np.uint64(len(shingle_set)) * np.uint64(0x9E3779B97F4A7C15)
        return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def sketch_bits(documents: int) -> int:
    """A row has 2^18 counters up to 4 million documents, then as many more as there are more documents, up to 2^22 (32 MB in all)."""
    return min(22, 18 + (max(documents - 1, 0) >> 22).bit_length())


def sketch_bits_of_text(size: int) -> int:
    """As many counters in a row that about 1024 shingles at most share one (6 bytes each, size in all), within the same bounds.

    With fewer, the chance counts of all others hide how common a shingle is, and common ones come first.
    """
    return min(22, max(18, (max(size, 1) // 6144 - 1).bit_length()))


def sketch_cells(shingle_set: np.ndarray, bits: int) -> np.ndarray:
    """The counters of each shingle, one row for each row of the sketch."""
    mask = np.uint64((1 << bits) - 1)
    return np.stack([(shingle_set >> np.uint64(r * bits)) & mask for r in range(SKETCH_ROWS)]).astype(np.int64)


def estimates(shingle_set: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Each shingle's counters, one row for each row of the sketch."""
    cells = sketch_cells(shingle_set, sketch.shape[1].bit_length() - 1)
    return np.stack([sketch[r][cells[r]] for r in range(SKETCH_ROWS)])


def rare_first(shingle_set: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set in the global order: by estimated count, then by hash."""
    return shingle_set[np.argsort(estimates(shingle_set, sketch).min(0), kind="stable")]


def prefix_size(n):
    """How many of the first shingles of a set of n must hold a common one for a similarity of 3/4."""
    return n - (3 * n + 3) // 4 + 1


def parities(shingle_set: np.ndarray) -> bytes:
    """For each value of the hashes' last bits whether the set has an odd number of them: at least as many bits as shingles, 64 to 65,536."""
    n = min(1 << 16, max(64, 1 << max(len(shingle_set) - 1, 0).bit_length()))
    counts = np.bincount((shingle_set & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Parities (one set a row) by one bit of the hashes less."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def differing(a: bytes, b: bytes) -> int:
    """Of two sets' parities: so many shingles at least are in one of the sets alone."""
    if len(a) < len(b):
        a, b = b, a
    x, n = int.from_bytes(a, "little"), 8 * len(a)
    while n > 8 * len(b):
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()
