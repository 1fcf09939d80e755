"""Words, shingle hashes and SimHash fingerprints of texts, on the bytes of Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SEED = 42
_LANES = np.uint64(0x0101010101010101)
_MIX, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_h64 = xxhash.xxh64_intdigest


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space: bytes.lower() and bytes.split() do exactly that."""
    return text.lower().split() if text else []


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of `size` words joined by a space; of the whole sequence, if it is shorter; none for no words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= size:
        return np.array([_h64(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    return np.fromiter([_h64(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)], np.uint64, n - size + 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set. Bytes of a word add up in lanes, 255 hashes at a time."""
    n = len(hashes)
    if n % 255:
        hashes = np.concatenate([hashes, np.zeros(255 - n % 255, np.uint64)])
    rows = hashes.reshape(-1, 255)
    counts = np.empty((8, 8), np.int64)
    for bit in range(8):
        lanes = ((rows >> np.uint64(bit)) & _LANES).sum(axis=1)
        counts[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.reshape(64)


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint: a bit is set if more than half of the hashes have it; 0 for no hashes."""
    if not len(hashes):
        return 0
    if len(hashes) == 1:
        return int(hashes[0])
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view(np.uint64)[0])


def wide_majority(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A SimHash fingerprint of 64 bits for each salt, as bytes: each hash is mixed anew for each salt, then as in majority()."""
    counts = np.zeros((8, len(salts), 8), np.int64)
    for at in range(0, len(hashes), 255):
        x = hashes[None, at : at + 255] + salts[:, None]
        x = (x ^ (x >> np.uint64(30))) * _MIX
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        x ^= x >> np.uint64(31)
        for bit in range(8):
            counts[bit] += ((x >> np.uint64(bit)) & _LANES).sum(axis=1).view(np.uint8).reshape(-1, 8)
    return np.packbits(2 * counts.transpose(1, 2, 0) > len(hashes), axis=2, bitorder="little").reshape(-1)


def signed(values) -> np.ndarray:
    """Unsigned 64-bit integers as Spark's longs."""
    return np.asarray(values, np.uint64).view(np.int64)


def texts_of(array) -> Iterator[bytes | None]:
    """The values of an Arrow string array as bytes, one at a time."""
    import pyarrow as pa

    for value in array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()):
        yield value.as_py()
