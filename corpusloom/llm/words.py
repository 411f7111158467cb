"""Words, their numbers within a task and their 128-bit names, for the operators that compare texts by words.

``bytes.lower`` changes A-Z alone, and U+0020 and U+0009-000D are bytes of their own in UTF-8, so words
``[^\\x20\\x09-\\x0D]+`` are found on bytes. A name is two 64-bit lanes of the word's BLAKE2b digest; names
of sequences come from a chain of bijections of the 128-bit state, so that neither words nor
sequences of a special form share names. Names find what may be equal; numbers, which are equal for equal words only,
tell whether it is."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

_STEP, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(state: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The states (2 lanes by n) after one more name each; for a fixed name a bijection of states, and the other way round."""
    a = mix(state[0] * _STEP + state[1] + name[0])
    return np.stack([a, mix((state[1] ^ name[1]) * _OTHER + a)])


def to_bytes(text: str | None, lower: bool = False) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.lower() if lower else data


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    return to_bytes(text, lower).split()


class Lexicon(dict):
    """Word to number, from 0, as words come; and the names of the numbers."""

    #: Words, and bytes of words, after which :meth:`full` says so.
    WORDS, BYTES = 50_000, 8_000_000

    def __init__(self):
        super().__init__()
        self._digests: list[bytes] = []
        self._names = np.zeros((2, 0), np.uint64)
        self._bytes = 0

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        self[word] = n
        self._digests.append(blake2b(word, digest_size=16).digest())
        self._bytes += len(word)
        return n

    def full(self) -> bool:
        return len(self) > self.WORDS or self._bytes > self.BYTES

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def names(self, numbers: np.ndarray) -> np.ndarray:
        """Two lanes by the given numbers."""
        if self._digests:
            fresh = np.frombuffer(b"".join(self._digests), np.uint64).reshape(-1, 2).T
            self._names = np.concatenate([self._names, fresh], 1)
            self._digests.clear()
        return self._names[:, numbers]


#: Windows that are named at once, to stay in a core's cache; words of texts that are put together.
BLOCK = 1 << 16


def window_names(names: np.ndarray, size: int) -> np.ndarray:
    """A name (2 lanes) for each run of ``size`` consecutive words (none if there are fewer)."""
    n = max(0, names.shape[1] - size + 1)
    out = np.empty((2, n), np.uint64)
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        state = np.full((2, end - at), size, np.uint64)
        for j in range(size):
            state = chain(state, names[:, at + j : end + j])
        out[:, at:end] = state
    return out


def numbered(texts: list[list[bytes]], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' words, one text after another: numbers, names (2 lanes), and where each text begins and the last ends."""
    numbers = np.concatenate([np.zeros(0, np.int64), *map(lexicon.numbers, texts)])
    return numbers, lexicon.names(numbers), np.cumsum([0, *map(len, texts)])


#: The first k bytes of eight.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that fit a name beside their number.
_SHORT = 15


def word_names(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts' words, one text after another: names (2 lanes), and where each text begins and the last ends. For
    those who need no numbers: a word of up to 15 bytes is named by a bijection of its bytes and their number, so equal names are equal
    words; a longer one by 120 bits of its BLAKE2b digest, apart from the names of the others."""
    words = [w for t in texts for w in t]
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    data = b"".join(words) + bytes(16)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place
    lanes = np.stack([eight[start], eight[start + 8]]).astype(np.uint64)
    lanes[0] &= _BYTES[np.minimum(size, 8)]
    lanes[1] &= _BYTES[np.clip(size - 8, 0, 7)]
    lanes[1] |= np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        lanes[:, long] = np.frombuffer(b"".join(blake2b(words[k], digest_size=16).digest() for k in long.tolist()), "<u8").reshape(-1, 2).T
        lanes[1, long] |= np.uint64(255) << np.uint64(56)
    return chain(lanes, np.zeros((2, 1), np.uint64)), np.cumsum([0, *map(len, texts)])


@dataclass
class Shingles:
    """The distinct shingles of a text, by name: the lanes of the names, ascending, a place of each, and the
    text's word numbers; ``exact`` if equal first lanes are of equal words."""

    numbers: np.ndarray
    size: int
    first: np.ndarray
    second: np.ndarray
    at: np.ndarray
    exact: bool

    def __len__(self) -> int:
        return len(self.first)

    def name(self) -> bytes:
        """16 bytes that name the set; empty for the empty set."""
        return blake2b(self.first.tobytes() + self.second.tobytes(), digest_size=16).digest() if len(self) else b""

    def sequences(self) -> set[tuple[int, ...]]:
        own = self.numbers.tolist()
        return {tuple(own[p : p + self.size]) for p in self.at.tolist()}


def _same_words(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: int) -> bool:
    return all(np.array_equal(a[at_a + j], b[at_b + j]) for j in range(size))


def shingles(texts: list[list[bytes]], lexicon: Lexicon, size: int = 5) -> list[Shingles]:
    """Of each text. Fewer words than ``size`` make one shingle of the whole sequence, no words none."""
    out: list[Shingles] = []
    group: list[list[bytes]] = []

    def settle():
        numbers, names, begins = numbered(group, lexicon)
        whole = window_names(names, size)
        for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            n = min(size, j - i)
            out.append(_distinct(numbers[i:j], whole[:, i : j - size + 1] if n == size else window_names(names[:, i:j], n), n))
        group.clear()

    for words in texts:
        group.append(words)
        if sum(map(len, group)) >= BLOCK:
            settle()
    settle()
    return out


def _distinct(numbers: np.ndarray, names: np.ndarray, size: int) -> Shingles:
    if not size:
        none = np.zeros(0, np.uint64)
        return Shingles(numbers, 0, none, none, np.zeros(0, np.int64), True)
    at = np.argsort(names[0], kind="stable")
    first = names[0][at]
    new = np.ones(len(at), bool)
    np.not_equal(first[1:], first[:-1], out=new[1:])
    again = np.flatnonzero(~new)
    exact = not len(again) or _same_words(numbers, at[again], numbers, at[again - 1], size)
    if not exact:
        at = np.lexsort((names[1], names[0]))
        first, second = names[0][at], names[1][at]
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = at[new]
    return Shingles(numbers, size, first[new], names[1][at], at, exact)


def overlap(a: Shingles, b: Shingles) -> int:
    """Shingles that two texts, numbered by one lexicon, share: found by name, compared as words."""
    if a.exact and b.exact and a.size == b.size:
        common, i, j = np.intersect1d(a.first, b.first, assume_unique=True, return_indices=True)
        if _same_words(a.numbers, a.at[i], b.numbers, b.at[j], a.size):
            return len(common)
    return len(a.sequences() & b.sequences())
