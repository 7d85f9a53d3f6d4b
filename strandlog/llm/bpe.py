"""Byte-level BPE encoding and decoding.

The merges of a rank file are compiled into a transducer over bytes. A prefix of
a piece has one encoding, and a sequence of tokens is an encoding exactly if each
two neighbours encode to themselves. So while bytes arrive, the only encodings
still alive are those that end where a longer token may begin. A state holds
them, less what they have in common: that is emitted. States and steps are made
when first met and kept in a hash table (lazy determinisation); how far emission
lags is bounded by the longest token. All distinct pieces of a batch walk the table
at once, a byte at a time. States and table together take at most ``ROOM`` bytes;
beyond that, the states that the fewest batches met are forgotten, and made again
if they are met again.

Decoding joins the tokens' bytes and runs them through ``Utf8Machine``, a state
machine that is fed chunk by chunk: it passes on whole characters, keeps an
unfinished one, of at most three bytes, for the next chunk, and puts U+FFFD in the
place of what is not UTF-8. The decoded bytes that a digest covers are the machine's.

Null text counts as empty and gives no tokens; repeated rows give repeated rows;
other columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, text_of

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes that states and steps may take; pairs of tokens remembered; longest piece, in bytes, that walks the table with others; characters of text taken at once.
ROOM, PAIRS, PIECE, BATCH = 64 << 20, 100_000, 256, 1 << 20
#: About what a state takes besides its description, in bytes, and a step in the table when that is half full.
STATE, STEP = 220, 32


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merged(ranks: dict[bytes, int], piece: bytes) -> tuple[int, ...]:
    """The definition: merge the pair of lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(ranks[p] for p in parts)


class Trie:
    """The vocabulary's words. Nodes are numbered level by level, so that a node's
    children are neighbours: node i's are ``first[i]`` to ``first[i + 1]``, and
    ``label`` has each node's byte."""

    def __init__(self, ranks: dict[bytes, int]):
        words = sorted(ranks)
        spans, label = [(0, len(words), 0)], bytearray(1)
        self.first, self.token = array("i"), array("i")
        for lo, hi, depth in spans:  # grows meanwhile
            whole = len(words[lo]) == depth
            self.token.append(ranks[words[lo]] if whole else -1)
            self.first.append(len(spans))
            at = lo + whole
            while at < hi:
                byte, begin = words[at][depth], at
                while at < hi and words[at][depth] == byte:
                    at += 1
                spans.append((begin, at, depth + 1))
                label.append(byte)
        self.first.append(len(spans))
        self.label = bytes(label)


class Steps:
    """Steps (state, byte) to (state, output) in an open hash table of arrays."""

    def __init__(self, slots: int = 1 << 12):
        self.key = np.full(slots, -1, np.int64)
        self.to, self.out, self.n = np.zeros(slots, np.int32), np.zeros(slots, np.int32), 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - len(self.key).bit_length())).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each key, or a free one."""
        slot = self._slot(key)
        got = self.key[slot]
        on = np.flatnonzero((got != key) & (got >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) % len(self.key)
            got = self.key[slot[on]]
            on = on[(got != key[on]) & (got >= 0)]
        return slot

    def find_one(self, key: int) -> int:
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 65 - len(self.key).bit_length()
        while (got := self.key[slot]) != key and got >= 0:
            slot = (slot + 1) % len(self.key)
        return slot

    def add(self, key: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """Adds distinct steps that are not there yet."""
        if 2 * (self.n + len(key)) > len(self.key):
            old = self.all()
            self.refill(1 << (2 * (self.n + len(key))).bit_length(), *(np.concatenate(x) for x in zip(old, (key, to, out), strict=True)))
            return
        self.n += len(key)
        while len(key):
            slot = self.find(key)
            _, mine = np.unique(slot, return_index=True)  # of keys that met in a slot the first gets it
            self.key[slot[mine]], self.to[slot[mine]], self.out[slot[mine]] = key[mine], to[mine], out[mine]
            left = np.ones(len(key), bool)
            left[mine] = False
            key, to, out = key[left], to[left], out[left]

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.key >= 0)
        return self.key[at], self.to[at], self.out[at]

    def refill(self, slots: int, key: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """Only these steps, in so many slots (at least twice as many)."""
        self.__init__(slots)
        self.add(key, to, out)


class Transducer:
    """Encodes pieces of bytes.

    An alive encoding is (node, last, pending): the bytes since its end spell the
    trie's node, ``last`` is its last token, ``pending`` its tokens not yet emitted.
    A state is described by its alive encodings, as numbers in bytes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.bytes_of[rank] = word
        self.trie = Trie(ranks)
        #: For each token the halves of its last merge; -1 for a byte, -2 for a token that merging never makes, -3 as long as nothing is known.
        self.left, self.right = (array("i", [-3]) * len(self.bytes_of) for _ in range(2))
        self.pairs: dict[int, bool] = {}
        #: As whole pieces these stay what they are, though merging never makes them.
        self.unmade = {w for w, r in ranks.items() if self._left(r) == -2}  # also settles ``left`` of all tokens
        self.batch = 0
        self.outs: dict[tuple[int, ...], int] = {(): 0}
        self.out_list: list[tuple[int, ...]] = [()]
        self.ids: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.rests = np.full(1024, -1, np.int32)  # of each state, the output that is left at a piece's end
        self.met, self.hits = np.zeros(1024, np.int32), np.zeros(1024, np.int32)  # the last batch that met it; how many did
        self.steps, self.described = Steps(), 0
        self.start = self._state(array("i", (0, -1, 0)).tobytes())

    def room(self) -> int:
        """Bytes that states and steps take, about."""
        return self.described + STATE * len(self.states) + STEP * self.steps.n

    def _state(self, alive: bytes) -> int:
        at = self.ids.get(alive)
        if at is None:
            at = self.ids[alive] = len(self.states)
            self.states.append(alive)
            self.described += len(alive)
            if at == len(self.met):
                self.rests = np.append(self.rests, np.full(at, -1, np.int32))
                self.met, self.hits = np.append(self.met, np.zeros(at, np.int32)), np.append(self.hits, np.zeros(at, np.int32))
        return at

    def _out(self, tokens: tuple[int, ...]) -> int:
        at = self.outs.get(tokens)
        if at is None:
            at = self.outs[tokens] = len(self.out_list)
            self.out_list.append(tokens)
        return at

    def thin(self) -> None:
        """Keeps the states that most batches met, at most half of the room."""
        n = len(self.states)
        order = np.lexsort((-self.met[:n], -self.hits[:n]))
        order = np.append(self.start, order[order != self.start])
        sizes = np.fromiter((len(self.states[i]) for i in order.tolist()), np.int64, n) + STATE + STEP
        kept = np.sort(order[: max(1, int(np.searchsorted(np.cumsum(sizes), ROOM // 2)))])
        number = np.full(n, -1, np.int64)
        number[kept] = np.arange(len(kept))
        self.states = [self.states[i] for i in kept.tolist()]
        self.ids = {s: i for i, s in enumerate(self.states)}
        self.described = sum(map(len, self.states))
        self.start = int(number[self.start])
        key, to, out = self.steps.all()
        inside = (number[key >> 8] >= 0) & (number[to] >= 0)
        key, to, out = number[key[inside] >> 8] << 8 | key[inside] & 255, number[to[inside]].astype(np.int32), out[inside]
        # Outputs that no step and no state's end uses go as well.
        rests = self.rests[kept]
        used = np.unique(np.concatenate([[0], out, rests[rests >= 0]]))
        self.out_list = [self.out_list[i] for i in used.tolist()]
        self.outs = {t: i for i, t in enumerate(self.out_list)}
        rests[rests >= 0] = np.searchsorted(used, rests[rests >= 0])
        self.steps.refill(max(1 << 12, 1 << (2 * len(key)).bit_length()), key, to, np.searchsorted(used, out).astype(np.int32))
        size = max(1024, 1 << (2 * len(kept)).bit_length())
        pad = lambda x, fill: np.append(x, np.full(size - len(x), fill, np.int32))
        self.rests, self.met, self.hits = pad(rests, -1), pad(self.met[kept], 0), pad(self.hits[kept] // 2, 0)

    def _left(self, token: int) -> int:
        """The left half of a token's last merge, see ``left``."""
        found = self.left[token]
        if found == -3:
            word, found, other = self.bytes_of[token], -1, -1
            if len(word) > 1:
                found, get = -2, self.ranks.get
                for i in range(1, len(word)):
                    a, b = get(word[:i], token), get(word[i:], token)
                    if a < token and b < token and self._fits(a, b, token):
                        found, other = a, b
                        break
            self.left[token], self.right[token] = found, other
        return found

    def _fits(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether the two stay apart when their bytes merge, but for merges of rank
        ``limit`` and more. Undoes the later merge of the two again and again: at no
        time may the parts at the border have had an earlier merge of their own."""
        key, whole = left << 32 | right, limit == 1 << 60
        if whole and (ok := self.pairs.get(key)) is not None:
            return ok
        ok, rank, word = True, self.ranks.get, self.bytes_of
        while True:
            if rank(word[left] + word[right], limit) < limit:
                ok = False
                break
            a, b = self._left(left), self._left(right)
            if a == -2 or b == -2:
                ok = False
                break
            if a >= 0 and (left > right or b < 0):
                limit, left = min(limit, left), self.right[left]
            elif b >= 0:
                limit, right = min(limit, right + 1), b
            else:
                break
        if whole:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """Where a byte leads from a state, and the output."""
        trie, known = self.trie, self.pairs.get
        token_of, first, find = trie.token, trie.first, trie.label.find
        old, alive, ended, i = array("i", self.states[state]).tolist(), [], None, 0
        while i < len(old):
            node, last, n = old[i : i + 3]
            i += 3 + n
            to = find(byte, first[node], first[node + 1])
            if to < 0:
                continue
            token = token_of[to]
            if token >= 0 and ended is None and self.left[token] != -2 and (last < 0 or ((ok := known(last << 32 | token)) is None and self._fits(last, token)) or ok):
                ended = [0, token, *old[i - n : i], token]
            if first[to] < first[to + 1]:
                alive.append([to, last, *old[i - n : i]])
        if ended is None:
            raise ValueError("the vocabulary lacks a byte")
        alive.append(ended)
        sure = alive[0]
        n = 2
        for n in range(2, min(map(len, alive)) + 1):
            if n == len(sure) or any([n == len(p) or p[n] != sure[n] for p in alive]):
                break
        new = array("i")
        for p in alive:
            new.extend((p[0], p[1], len(p) - n, *p[n:]))
        return self._state(new.tobytes()), self._out(tuple(sure[2:n]))

    def _steps(self, keys: np.ndarray) -> None:
        """Adds the steps of these keys."""
        made = np.array([self._step(k >> 8, k & 255) for k in keys.tolist()], np.int32)
        self.steps.add(keys, made[:, 0], made[:, 1])

    def _rest(self, state: int) -> int:
        """The output that is left if a piece ends here."""
        if self.rests[state] < 0:
            old, i = memoryview(self.states[state]).cast("i"), 0
            while i < len(old):
                last = tuple(old[i + 3 : i + 3 + old[i + 2]])
                i += 3 + old[i + 2]
            self.rests[state] = self._out(last)
        return int(self.rests[state])

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.unmade:
            return [self.ranks[piece]]
        out: list[int] = []
        at, steps = self.start, self.steps
        for b in piece:
            slot = steps.find_one(at << 8 | b)
            if steps.key[slot] < 0:
                if self.room() > ROOM:
                    here = self.states[at]
                    self.thin()
                    at = self._state(here)
                self._steps(np.array([at << 8 | b]))
                slot = steps.find_one(at << 8 | b)
            self.met[at] = self.batch
            out += self.out_list[steps.out[slot]]
            at = int(steps.to[slot])
        return out + list(self.out_list[self._rest(at)])

    def encode_all(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces (large_binary, none empty) on end, and how many each has."""
        n = len(pieces)
        self.batch += 1
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + n + 1]
        buf = np.frombuffer(pieces.buffers()[2], np.uint8) if n else np.zeros(0, np.uint8)
        size = np.diff(offsets)
        alone = np.flatnonzero(size > PIECE)
        if self.unmade:
            alone = np.union1d(alone, np.flatnonzero(pc.is_in(pieces, pa.array(list(self.unmade), pa.large_binary())).to_numpy(False)))
        walk = np.ones(n, bool)
        walk[alone] = False
        walk = np.flatnonzero(walk)
        walk = walk[np.argsort(-size[walk], kind="stable")]
        values, per = self._walk(buf, offsets[walk], size[walk])
        rows = [self.encode(buf[offsets[i] : offsets[i + 1]].tobytes()) for i in alone.tolist()]
        more, lens = _ragged(rows)
        self.hits[self.met == self.batch] += 1
        place = np.empty(n, np.int64)
        place[np.concatenate([walk, alone])] = np.arange(n)
        return _taken(np.concatenate([values, more]), np.concatenate([per, lens]), place)

    def _walk(self, buf: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces by falling length, all at once."""
        n, long = len(begin), int(length[0]) if len(begin) else 0
        at = np.full(n, self.start, np.int64)
        longer = np.append(np.searchsorted(-length, -np.arange(long), side="left"), n)
        rows, taken, counts = [], [], []
        for j in range(long + 1):
            m = int(longer[j])
            if j < long:
                here = at[:m]
                key = here << 8 | buf[begin[:m] + j]
                slot = self.steps.find(key)
                lost = self.steps.key[slot] < 0
                if lost.any():
                    if self.room() > ROOM:
                        old, back = np.unique(at, return_inverse=True)
                        alive = [self.states[s] for s in old.tolist()]
                        self.thin()
                        at = np.array([self._state(s) for s in alive], np.int64)[back]
                        here = at[:m]
                        key = here << 8 | key & 255
                        lost = self.steps.key[self.steps.find(key)] < 0
                    self._steps(np.unique(key[lost]))
                    slot = self.steps.find(key)
                self.met[here] = self.batch
                out = self.steps.out[slot]
                at[:m] = self.steps.to[slot]
            else:
                ends, back = np.unique(at, return_inverse=True)
                self.met[ends] = self.batch
                for state in ends[self.rests[ends] < 0].tolist():
                    self._rest(state)
                out = self.rests[ends][back]
            some = np.flatnonzero(out)
            if len(some):
                kinds, back = np.unique(out[some], return_inverse=True)
                v, c = _taken(*_ragged([self.out_list[i] for i in kinds.tolist()]), back)
                rows.append(some)
                taken.append(v)
                counts.append(c)
        if not rows:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        row, values, count = (np.concatenate(x) for x in (rows, taken, counts))
        order = np.argsort(row, kind="stable")
        return _taken(values, count, order)[0], np.bincount(row, weights=count, minlength=n).astype(np.int64)


def _ragged(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows as their values on end, and the length of each."""
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((x for r in rows for x in r), np.int32, int(counts.sum())), counts


def _taken(values: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for a choice of rows."""
    begins = np.cumsum(counts) - counts
    n = counts[rows]
    ends = np.cumsum(n)
    return values[np.repeat(begins[rows] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], n


#: States of the UTF-8 machine: what may come next. The number of tail bytes still due, or a lead byte that narrows down its first tail byte.
DONE, ONE, TWO, THREE, E0, ED, F0, F4, WRONG = range(9)


def utf8_table() -> bytes:
    """The next state, at 256 * state + byte, by the table of well-formed sequences."""
    after = bytearray([WRONG]) * (9 * 256)

    def rule(state: int, lo: int, hi: int, to: int) -> None:
        after[256 * state + lo : 256 * state + hi + 1] = bytes([to]) * (hi - lo + 1)

    for lo, hi, to in ((0x00, 0x7F, DONE), (0xC2, 0xDF, ONE), (0xE1, 0xEF, TWO), (0xE0, 0xE0, E0), (0xED, 0xED, ED), (0xF1, 0xF3, THREE), (0xF0, 0xF0, F0), (0xF4, 0xF4, F4)):
        rule(DONE, lo, hi, to)
    for state, lo, hi, to in ((ONE, 0x80, 0xBF, DONE), (TWO, 0x80, 0xBF, ONE), (THREE, 0x80, 0xBF, TWO), (E0, 0xA0, 0xBF, ONE), (ED, 0x80, 0x9F, ONE), (F0, 0x90, 0xBF, TWO), (F4, 0x80, 0x8F, TWO)):
        rule(state, lo, hi, to)
    return bytes(after)


class Utf8Machine:
    """Bytes to whole characters, chunk by chunk. Between chunks it has a state and
    the unfinished character's bytes, three at most. Stretches of ASCII pass
    in one go; other bytes take a step each. What is not UTF-8 becomes U+FFFD, one
    for each longest beginning of a character."""

    NEXT = utf8_table()
    WIDE = re.compile(rb"[\x80-\xff]")
    BAD = "\ufffd".encode()

    def __init__(self):
        self.state, self.rest = DONE, b""

    def feed(self, chunk: bytes) -> bytes:
        """The characters finished by now."""
        if self.state == DONE and chunk.isascii():
            return chunk
        out: list[bytes] = []
        state, step, at, chunk = self.state, self.NEXT, len(self.rest), self.rest + chunk
        begin = done = 0  # of the unfinished character; up to where out is complete
        while at < len(chunk):
            if state == DONE:  # on to the next byte that is not ASCII
                wide = self.WIDE.search(chunk, at)
                if wide is None:
                    at = len(chunk)
                    break
                begin = at = wide.start()
            to = step[256 * state + chunk[at]]
            if to != WRONG:
                at, state = at + 1, to
                continue
            out += [chunk[done:begin], self.BAD]
            at += state == DONE  # else the byte may begin a character
            begin = done = at
            state = DONE
        if state == DONE:
            begin = len(chunk)
        self.state, self.rest = state, chunk[begin:]
        out.append(chunk[done:begin])
        return b"".join(out)

    def close(self) -> bytes:
        """U+FFFD for a character that never was finished."""
        rest, self.state, self.rest = self.rest, DONE, b""
        return self.BAD if rest else b""


#: Classes of bytes in UTF-8 text of characters up to U+024F: letter, number, white space, other.
LETTER, NUMBER, SPACE, OTHER = 1, 2, 4, 8
_class = np.full(256, OTHER, np.uint8)
_class[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = LETTER
_class[48:58] = NUMBER
_class[[9, 10, 11, 12, 13, 32]] = SPACE
#: Second bytes after 0xC2 of letters, numbers and white space; after 0xC3, of the two that are not letters.
C2 = {LETTER: (0xAA, 0xB5, 0xBA), NUMBER: (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE), SPACE: (0x85, 0xA0)}
C3 = (0x97, 0xB7)
TAILS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def latin_begins(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the public pattern's pieces begin, in the bytes of texts of characters
    up to U+024F (of other texts the answer is of no use). Whole-array form of the
    pattern: runs of one class, with a blank before; of white space before anything
    else the last goes on its own, or with what follows if it is a blank."""
    kind = _class[buf]
    wide = np.flatnonzero((buf == 0xC2) | (buf == 0xC3))
    wide = wide[wide + 1 < len(buf)]
    second = buf[wide + 1]
    c2 = buf[wide] == 0xC2
    for k, seconds in C2.items():
        kind[wide[c2 & np.isin(second, seconds)]] = k
    kind[wide[~c2 & np.isin(second, C3)]] = OTHER
    tail = np.flatnonzero((buf & 0xC0) == 0x80)
    kind[tail] = kind[tail - 1]  # two bytes at most
    first = np.zeros(len(buf), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[begins] = True
    blank = buf == 32
    after = np.flatnonzero(first & (kind != SPACE))  # where something follows white space, with a blank before it
    after = after[after > 0]
    after = after[(kind[after - 1] == SPACE) & ~np.isin(after, begins)]
    last = after - 1 - ((buf[after - 1] & 0xC0) == 0x80)
    first[after[blank[last]]] = False
    first[last] = True
    quote = np.flatnonzero(first & (buf == 39)).tolist()
    if quote:
        data, over = buf.tobytes(), np.append(ends, len(buf))
        limit = over[np.searchsorted(ends, quote, side="right")].tolist()
        done = -1
        for i, end in zip(quote, limit, strict=True):
            if i < done:
                continue
            for t in TAILS:
                if data.startswith(t, i + 1, end):
                    done = i + 1 + len(t)
                    first[i + 1 : done] = False
                    if done < end:
                        first[done] = True
                    break
    return first


class Codec:
    """encode() and decode() of whole texts by one vocabulary and splitting pattern.

    By the public pattern, texts of characters up to U+024F are split all at once,
    others by the pattern itself. Each distinct piece of a batch is encoded once.
    """

    def __init__(self, path: str, pattern: str):
        import public_tokenizers
        import regex

        ranks = load_ranks(path)
        self.fst = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.public = pattern == public_tokenizers.PATTERN
        self.bytes_of = self.fst.bytes_of
        self.words = pa.array(self.bytes_of, pa.large_binary())
        self.names = pa.array([str(i) for i in range(len(self.bytes_of))], pa.large_string())

    def pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts, and how many each text has."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        data = b"".join(raw)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(size)
        begins = (ends - size)[size > 0]
        buf = np.frombuffer(data, np.uint8)
        first = latin_begins(buf, begins, ends) if self.public else np.zeros(len(buf), bool)
        beyond = np.append(0, np.cumsum((buf > 0xC9) | (buf < 32) & (buf > 13) | (buf == 0xC9) & np.append(buf[1:] > 0x8F, False)))
        for i in np.flatnonzero((size > 0) & ((beyond[ends] > beyond[ends - size]) | (not self.public))):
            lo, hi = int(ends[i] - size[i]), int(ends[i])
            first[lo:hi] = False
            first[lo + np.cumsum([0, *[len(p.encode()) for p in self.split(raw[i].decode())[:-1]]])] = True
        at = np.flatnonzero(first)
        offsets = np.append(at, len(buf)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pieces, np.diff(np.searchsorted(at, np.append(0, ends)))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and how many each has."""
        pieces, per_text = self.pieces(texts)
        coded = pieces.dictionary_encode()
        ids, n = _taken(*self.fst.encode_all(coded.dictionary), coded.indices.to_numpy())
        return ids, np.diff(np.append(0, np.cumsum(n))[np.append(0, np.cumsum(per_text))])

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_bytes(self, ids: Iterable[int], chunk: int = 65_536) -> Iterator[bytes]:
        """The characters of ids, streamed by chunks of tokens."""
        machine, ids = Utf8Machine(), pa.array(ids, pa.int32())
        for i in range(0, len(ids), chunk):
            words = self.words.take(ids[i : i + chunk])
            lo, hi = (int(x) for x in np.frombuffer(words.buffers()[1], np.int64)[[0, len(words)]])
            yield machine.feed(words.buffers()[2][lo:hi].to_pybytes())
        yield machine.close()

    def decode(self, ids: Iterable[int], chunk: int = 65_536) -> Iterator[str]:
        """The same as text."""
        for part in self.decode_bytes(ids, chunk):
            yield part.decode()

    def digests(self, ids: np.ndarray, counts: np.ndarray) -> tuple[list[str], list[str]]:
        """sha256 of each text's ids in decimals, and of the bytes they decode to."""
        offsets, taken = np.append(0, np.cumsum(counts)), pa.array(ids)
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), self.names.take(taken))
        joined = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
        decoded = []
        for i in range(len(counts)):
            sha = hashlib.sha256()
            for part in self.decode_bytes(taken[offsets[i] : offsets[i + 1]]):
                sha.update(part)
            decoded.append(sha.hexdigest())
        return [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined], decoded


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker process keeps the one that it used last."""
    if (path, pattern) not in _codecs:
        _codecs.clear()
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def bites(texts: list[str]) -> Iterator[slice]:
    """Slices of about BATCH characters."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= BATCH:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, *, ids: bool = True, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and by choice the ids, and sha256 of ids and decoded bytes.

    ``path`` names a rank file present on every executor (default: the installed
    vocabulary, looked up where the task runs).
    """

    small_batches(docs.sparkSession)

    def run(batches):
        import public_tokenizers

        c = codec(path or vocabulary_path(), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in bites(texts):
                found, n = c.encode_all(texts[part])
                columns = [doc_ids[part], pa.array(n, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(found)))
                if digests:
                    columns += [pa.array(x) for x in c.digests(found, n)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text of rows with doc_id, ids; null ids give null text."""

    small_batches(encoded.sparkSession)

    def run(batches):
        import public_tokenizers

        c = codec(path or vocabulary_path(), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            texts = ["".join(c.decode(i)) if i is not None else None for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ids=False, digests=True)
