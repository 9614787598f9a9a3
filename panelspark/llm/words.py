"""Words and word shingles as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

import numpy as np

from panelspark.llm.common import mix, window_hash

_base = np.uint64(0xD6E8FEB86659FD93)
# Word bytes: lower-case ASCII letters, digits, and every byte of a character beyond ASCII.
_is_word = np.zeros(256, bool)
_is_word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text). Case and what stands between words do not count."""
    raws = [t.lower().encode() if t else b"" for t in texts]
    sizes = np.array([len(r) + 1 for r in raws], np.int64)
    b = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    inside = _is_word[b]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    lengths = np.flatnonzero(edge == -1) - starts
    spelled = b[inside].astype(np.uint64) + np.uint64(1)
    at = np.arange(len(spelled), dtype=np.int64)
    begin = np.cumsum(lengths) - lengths
    at -= np.repeat(begin, lengths)
    power = np.ones(int(lengths.max()), np.uint64)
    power[1:] = np.multiply.accumulate(np.full(len(power) - 1, _base, np.uint64))
    sums = np.add.reduceat(spelled * power[at], begin)
    ends = np.cumsum(sizes)
    upto = np.searchsorted(starts, ends)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.diff(upto, prepend=0)


def shingles(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k successive words of one text, its text). A text of fewer words is one shingle; of none, none."""
    text = np.repeat(np.arange(len(counts)), counts)
    full = window_hash(words, k) if len(words) >= k else np.zeros(0, np.uint64)
    same = text[: len(full)] == text[k - 1 : k - 1 + len(full)]
    hashes, owner = full[same], text[: len(full)][same]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begin = np.cumsum(counts) - counts
        extra = np.array([window_hash(words[begin[i] : begin[i] + counts[i]], int(counts[i]))[0] for i in short], np.uint64)
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, short])
    return hashes, owner


def counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, owner) with their counts, ordered by owner and hash."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h)))
