"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

The tokens of a prefix of a word are unique, and two tokens may stand side by side exactly if no
merge across their border would have come before the merges that made them. So a word is read by a
nondeterministic transducer whose configurations are (last token, bytes read of the next one): it
closes a token where the bytes are one that may follow. Its sets of configurations, each with the
tokens it has over what all agree on, are the states of a deterministic one; a step writes what all
configurations agree on, which is at most some tokens behind the reader. States and steps are made
when a text first needs them, kept in a bounded table and made again after it was full. Its time is linear in a word's length. Short words' tokens are remembered, in a
bounded table too.

Decoding streams: an automaton over UTF-8 says where in what is joined so far a code point is still open, and those bytes wait for the next tokens.

Rows: a null or empty text has no ids; repeated rows are each answered; an empty table gives no rows.
Other columns pass through; `ids` and `decoded` are replaced. Null ids decode to nothing.
"""

from __future__ import annotations

import base64
import gc
import sys
from array import array
from functools import cache, partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from scrollmill.llm.common import table, with_text_columns

#: Steps of the deterministic transducer that a worker keeps (some 500 bytes each), pairs of tokens that it has tried, and words whose tokens it remembers.
MOST_STEPS, MOST_PAIRS, MOST_WORDS = 200_000, 300_000, 100_000
#: Where up to so many tokens go on from what is read, those that may follow stand for the last token, so more states are alike.
FEW = 32
#: Longer words are not remembered; longer texts are split into words one by one.
LONG_WORD, LONG_TEXT = 64, 1 << 20
#: Rows that are coded together.
AT_ONCE = 128
#: Tokens that a decoder joins before it writes.
FLUSH = 4096


class Transducer:
    """Of a vocabulary {bytes: rank} whose ranks are its ids, with all single bytes in it."""

    def __init__(self, ranks: dict[bytes, int], most_steps: int = MOST_STEPS):
        self.ranks, self.most = ranks, most_steps
        self.spelled = {i: t for t, i in ranks.items()}
        #: What longer tokens begin with, and which these are.
        self.begun: dict[bytes, list[int]] = {}
        for t, i in ranks.items():
            for k in range(1, len(t)):
                self.begun.setdefault(t[:k], []).append(i)
        self.halves: dict[int, tuple[int, int] | None] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            self._split(t, i)
        #: Tokens that no merges make; they count only as whole words.
        self.odd = {t: i for t, i in ranks.items() if i not in self.halves}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.few: dict[tuple[int | None, bytes], tuple[int, ...]] = {}
        self._clear()

    def _split(self, token: bytes, rank: int) -> None:
        """The two tokens whose merge makes this one; tokens of lower rank are split before."""
        if len(token) == 1:
            self.halves[rank] = None
            return
        for k in range(1, len(token)):
            a, b = self.ranks.get(token[:k], rank), self.ranks.get(token[k:], rank)
            if a < rank and b < rank and a in self.halves and b in self.halves and self._side_by_side(a, b, rank):
                self.halves[rank] = a, b
                return

    def _side_by_side(self, a: int, b: int, below: int) -> bool:
        """No merge across the border of a and b comes before rank `below`, or before the merges that made what meets there.

        The merges are undone from the last one. Of equal pairs the left one is merged first.
        """
        while True:
            if self.ranks.get(self.spelled[a] + self.spelled[b], below) < below:
                return False
            left, right = self.halves[a], self.halves[b]
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                below, a = a, left[1]
            else:
                below, b = b + 1, right[0]

    def _follows(self, a: int | None, b: int) -> bool:
        if a is None:
            return b in self.halves
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = b in self.halves and self._side_by_side(a, b, len(self.ranks) + 1)
        return known

    def _ahead(self, last: int | None, read: bytes):
        """What is to know of the last token where `read` was read of the next: which of the few tokens begun there may follow, or itself."""
        some = self.begun[read]
        if len(some) > FEW:
            return last
        if (known := self.few.get((last, read))) is None:
            if len(self.few) >= MOST_PAIRS:
                self.few.clear()
            known = self.few[last, read] = tuple([t for t in some if self._follows(last, t)])
        return known

    def _clear(self) -> None:
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.states: list[tuple] = []
        self.ends: list[tuple[int, ...]] = []
        self.numbers: dict[tuple, int] = {}
        self.made = 0
        self._number(((None, b"", ()),))

    def _number(self, state: tuple) -> int:
        if (number := self.numbers.get(state)) is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.ends.append(state[-1][2])
        return number

    def _step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The step of a state, made now: the next state and the tokens that all its configurations share."""
        read, closed, byte_ = [], None, bytes((byte,))
        for last, before, behind in self.states[number]:
            more = before + byte_
            token, longer = self.ranks.get(more), more in self.begun
            if type(last) is tuple:
                if token in last:
                    closed = token, b"", (*behind, token)
                if longer and (left := tuple([t for t in last if t != token and self.spelled[t].startswith(more)])):
                    read.append((left, more, behind))
            else:
                if token is not None and self._follows(last, token):
                    closed = token, b"", (*behind, token)
                if longer and (left := self._ahead(last, more)) != ():
                    read.append((left, more, behind))
        read.append(closed)  # every prefix has tokens
        shared, least = 0, min([len(c[2]) for c in read])
        while shared < least and all([c[2][shared] == closed[2][shared] for c in read]):
            shared += 1
        out = closed[2][:shared]
        state = tuple([(last, begun, behind[shared:]) for last, begun, behind in read]) if shared else tuple(read)
        if self.made >= self.most:
            self._clear()
            return self._number(state), out
        self.made += 1
        step = self.steps[number][byte] = self._number(state), out
        return step

    def word(self, word: bytes, put) -> None:
        """put() gets the tokens of a word, piece by piece."""
        if word in self.odd:
            put((self.odd[word],))
            return
        at, steps = 0, self.steps
        for byte in word:
            step = steps[at].get(byte)
            if step is None:
                step = self._step(at, byte)
                steps = self.steps
            at, out = step
            if out:
                put(out)
        put(self.ends[at])


def utf8_steps() -> np.ndarray:
    """steps[state, byte]: 0 is between code points; a byte that cannot follow begins anew.

    1, 2, 3 wait for so many continuation bytes; 4 to 7 for a second byte after E0, ED, F0 and F4.
    """
    steps = np.zeros((8, 256), np.uint8)
    for low, high, state in ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3), (0xE0, 0xE0, 4), (0xED, 0xED, 5), (0xF0, 0xF0, 6), (0xF4, 0xF4, 7)):
        steps[0, low : high + 1] = state
    steps[1:] = steps[0]
    for state, low, high, after in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        steps[state, low : high + 1] = after
    return steps


UTF8 = utf8_steps().tolist()


def open_bytes(data: bytes) -> int:
    """How many bytes at the end begin a code point that is not complete: the automaton's run from the last byte that may begin one."""
    for back in range(1, min(4, len(data)) + 1):
        if data[-back] & 0xC0 != 0x80:
            state = 0
            for byte in data[len(data) - back :]:
                state = UTF8[state][byte]
            return back if state else 0
    return 0


def chunks(ids, spelled: dict[int, bytes]):
    """Bytes of the ids, cut between code points; the last chunk may end inside one."""
    rest = b""
    for a in range(0, len(ids), FLUSH):
        data = rest + b"".join(map(spelled.__getitem__, ids[a : a + FLUSH]))
        still = open_bytes(data)
        data, rest = data[: len(data) - still], data[len(data) - still :]
        yield data
    yield rest


def text_of(ids, spelled: dict[int, bytes]):
    """Text of the ids, piece by piece; bytes that are no UTF-8 become U+FFFD."""
    return (part.decode("utf-8", "replace") for part in chunks(ids, spelled))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}


@cache
def transducer(path: str) -> Transducer:
    return Transducer(read_ranks(path))


@cache
def spelling(path: str) -> dict[int, bytes]:
    return {i: t for t, i in read_ranks(path).items()}


class Known(dict):
    """Packed ids of strings (some 200 bytes each), made by `make` when first asked for. Of two generations the older goes when the younger is full, so strings that recur stay."""

    def __init__(self, make, most: int = MOST_WORDS):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if (packed := self.older.get(key)) is None:
            packed = self.make(key)
        if len(key) <= LONG_WORD:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = packed
        return packed


@cache
def coder(path: str, pattern: str):
    """A function from a text to its packed ids; what it remembers is for all tasks of a worker."""
    import regex

    own, split = transducer(path), regex.compile(pattern)

    def word(text: str) -> bytes:
        tokens: list[int] = []
        own.word(text.encode("utf-8", "surrogatepass"), tokens.extend)
        packed = array("I", tokens)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    words = Known(word)

    def by_words(text: str) -> bytes:
        return b"".join(map(words.__getitem__, split.findall(text) if len(text) < LONG_TEXT else (m.group() for m in split.finditer(text))))

    return by_words


def _encoder(path: str, pattern: str):
    one = coder(path, pattern)

    def many(texts):
        gc.disable()  # of the many small tuples none is in a cycle
        try:
            return [[one(t or "") for t in texts]]
        finally:
            gc.enable()

    return many


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`docs` with `ids`: the tokens of each text by the ranks in `path` (on every executor), each match of `pattern` separately; packed as little-endian 32-bit integers."""
    return with_text_columns(docs, "text", "ids binary", partial(_encoder, path, pattern), AT_ONCE)


def unpacked(ids: bytes | None) -> list[int]:
    return np.frombuffer(ids or b"", "<u4").tolist()


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Rows of packed `ids` with `decoded`, their bytes."""
    return with_text_columns(rows, "ids", "decoded binary", lambda: lambda lists: [[b"".join(chunks(unpacked(ids), spelling(path))) for ids in lists]], AT_ONCE)


def decode_text(rows: DataFrame, path: str) -> DataFrame:
    """Rows of packed `ids` with `decoded`, their text; bytes that are no UTF-8 become U+FFFD."""
    return with_text_columns(rows, "ids", "decoded string", lambda: lambda lists: [["".join(text_of(unpacked(ids), spelling(path))) for ids in lists]], AT_ONCE)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN), path)
    return found.selectExpr("doc_id", "cast(octet_length(ids) div 4 as bigint) as n_tokens", "sha2(ids, 256) as ids_sha256", "sha2(decoded, 256) as decoded_sha256")
