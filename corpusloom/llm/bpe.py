"""Byte-level BPE encoding and decoding in linear time.

Bytes are read as Latin-1 so that an Aho-Corasick automaton over the vocabulary finds the longest
token that starts at a place. The encoder takes it if it is compatible with the token before it,
else the next shorter token, else it steps back. Two tokens are compatible when the merges, run
over their bytes alone, end in just these two; that is memoised, and a sequence in which all
neighbours are compatible is the one that the merges give.

Defined results: a null text is the empty text, which has no tokens. Rows repeat as often as they
are given. Columns other than the text are passed on as they are."""

from __future__ import annotations

import base64
from collections.abc import Iterable
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.store import tidy

#: Entries of one generation of a worker's memos (two are held), and the longest piece that is kept in one.
MEMO, MEMO_PIECE = 150_000, 48

#: Bytes that one scan for longest tokens covers, so that stepping back in a long piece costs no more than in a short one.
SPAN = 256


class _Memo(dict):
    """What ``make`` gives, by key. When a generation is full it becomes the old one, from which keys that
    are asked for again are taken over; so what is frequent stays and what is not goes."""

    def __init__(self, make, keep=lambda key: True):
        super().__init__()
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
            if not self.keep(key):
                return value
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteBPE:
    """Encoder and decoder of a rank file (lines of a base64 token and its rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.lengths = {v: len(k) for k, v in self.ranks.items()}
        self.reach = max(self.lengths.values())
        # \s of the pattern means Unicode's White_Space
        self.split = regex.compile(pattern.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.compatible = _Memo(self.fits)
        self.pieces = _Memo(lambda piece: np.array(self.encode_piece(piece.encode("utf-8", "surrogatepass")), np.int32).tobytes(), lambda piece: len(piece) <= MEMO_PIECE)

    def merge(self, data: bytes, least: int = 1) -> list[int]:
        """The merges themselves, lowest rank and then leftmost first, until ``least`` parts are left; for
        short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > least:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def split_token(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the merges join last to make this one: twice itself for a byte, None for a
        token that no merges make."""
        if token not in self.halves:
            data = self.tokens[token]
            if len(data) == 1:
                self.halves[token] = (token, token)
            else:
                last = self.merge(data, 2)
                self.halves[token] = (last[0], last[1]) if len(last) == 2 else None
        return self.halves[token]

    def fits(self, pair: tuple[int, int]) -> bool:
        """Whether the merges over the bytes of the two tokens end in just these two.

        Merges inside each token go on apart until one joins across the border. So the merges are undone
        from the last one back; at each state the parts that touch the border must not join before the
        merge that was undone would have, where equal ranks go to the left one."""
        a, b = pair
        ranks, tokens = self.ranks, self.tokens
        if self.split_token(a) is None or self.split_token(b) is None:
            return False
        bound = 1 << 60  # a joint of a smaller rank than this comes too early
        while True:
            if ranks.get(tokens[a] + tokens[b], 1 << 60) < bound:
                return False
            one_a, one_b = len(tokens[a]) == 1, len(tokens[b]) == 1
            if one_a and one_b:
                return True
            if one_b or (not one_a and a > b):
                bound, a = a, self.split_token(a)[1]
            else:
                bound, b = b + 1, self.split_token(b)[0]

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if (known := self.shorter.get(token)) is None:
            data, ranks = self.tokens[token], self.ranks
            known = self.shorter[token] = next((ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in ranks), -1)
        return None if known < 0 else known

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        compatible, lengths, n = self.compatible, self.lengths, len(data)

        def from_here(start: int):
            """Longest tokens from this place on, each after the one before it, and the place up to which that holds."""
            stop = start + SPAN + self.reach
            return self.automaton.iter_long(data[start:stop].decode("latin-1")), stop - self.reach if stop < n else n

        out, at, dead = [], 0, set()
        longest, until = from_here(0)
        token = next(longest)[1]
        while True:
            end = at + lengths[token]
            if (not out or compatible[out[-1], token]) and end not in dead:
                out.append(token)
                if end == n:
                    return tuple(out)
                at = end
                if at > until:
                    longest, until = from_here(at)
                token = next(longest)[1]
                continue
            while (token := self.next_shorter(token)) is None:  # no token fits here: whatever ends at this place is wrong
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
            longest, until = from_here(at + lengths[token])

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split(text))), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """One coder per worker and vocabulary."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE(path, pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` array<int> of the whole text and ``decoded`` binary, the bytes that
    the ids give back. ``path`` is a rank file that every executor can open."""
    source = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    schema = T.StructType([*source.drop("__text").schema, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, decoded = [], []
                for t in part.column(part.num_columns - 1).to_pylist():
                    ids.append(own.ids(t or ""))
                    decoded.append(own.decode(ids[-1].tolist()))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(decoded, pa.binary())], names=schema.names)

    return source.mapInArrow(tidy(run), schema)


def digests(ids: Column, decoded: Column) -> list[Column]:
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    ]
