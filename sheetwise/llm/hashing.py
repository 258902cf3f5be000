"""Hashes of words and of word shingles for many texts at once, in numpy, inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
GAPS = np.zeros(256, bool)
GAPS[[9, 10, 11, 12, 13, 32]] = True  # the bytes of white space; no other character holds them in UTF-8
#: Texts are hashed in chunks of about this many bytes, so memory does not depend on the batch.
CHUNK = 1 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) | U64(1)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as UTF-8 in runs of about ``CHUNK`` bytes: index of the first, and the run."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        run.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(run[-1])
        if size >= CHUNK:
            yield first, run
            first, run, size = i + 1, [], 0
    if run:
        yield first, run


def parts(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``CHUNK`` bytes of text, so that what is made of them need not be held all at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        end = min(int(np.searchsorted(ends, before + CHUNK)) + 1, batch.num_rows)
        yield batch.slice(first, end - first)
        first = end


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, the start and the end of every word there, and how many words each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), np.uint8)
    gap = GAPS[data]
    gap[-8:] = True
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return data, starts, ends, np.diff(np.searchsorted(starts, text_ends), prepend=0)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word in order, and how many words each text has."""
    data, starts, ends, counts = word_places(texts)
    sizes = ends - starts
    eights = np.ndarray((max(len(data) - 7, 0),), "<u8", data.tobytes(), strides=(1,))  # the eight bytes from each place on
    out = mix(sizes.astype(U64))
    todo = np.arange(len(starts))
    at = 0
    while len(todo):
        block = eights[starts[todo] + at]
        left = np.minimum(sizes[todo] - at, 8)
        block &= U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * left.astype(U64))
        out[todo] = mix(out[todo] * U64(3) + block)
        at += 8
        todo = todo[sizes[todo] > at]
        if at >= LONG_WORD:
            break
    for i in todo:
        whole = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = U64(int.from_bytes(whole, "little"))
    return out, counts


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words in order, and how many each text has.

    A text with fewer words, but some, has one shingle: all its words.
    """
    factors = odd_numbers(width, 5)
    n = len(words)
    full = np.zeros(n, U64)
    if n >= width:
        total = np.zeros(n - width + 1, U64)
        for j in range(width):
            total += factors[j] * words[j : n - width + 1 + j]
        full[: n - width + 1] = mix(total)
    ends = np.cumsum(counts)
    begins = ends - counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    for i in short:
        own = words[begins[i] : ends[i]]
        full[begins[i]] = mix((factors[: len(own)] * own).sum(keepdims=True) + U64(len(own)))[0]
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    keep = np.arange(n) - np.repeat(begins, counts) < np.repeat(sizes, counts)
    return full[keep], sizes
