"""Byte-level BPE encoding and decoding (6).

Encoding: the merges are compiled into a finite-state transducer over bytes
whose states are determinised lazily.  A sequence of tokens is the BPE encoding
of its bytes exactly if each token encodes to itself and each adjacent pair
encodes to that pair; so each prefix of a text has one last token, and a state
holds, for every start of a still possible token, the vocabulary-trie node
reached and the tokens chosen up to that start.  What all of these agree on is
emitted: lookahead is bounded by the longest token.  Each piece of the pattern
is read from the start state; all different pieces of a batch of texts advance
together, a byte a step, through a hash table of transitions held in arrays, and
a transition is made when a piece first asks for it.  States and transitions are
dropped together when their number passes a bound.  Only what lies beyond the
first WIDTH bytes of a piece is read without making states, by the same
transducer in its undetermined form.

Decoding: bytes of the ids, checked by an incremental UTF-8 state machine lifted
to tokens (state and token give the next state); ids that aren't the encoding of
a text go through the machine byte by byte, and what belongs to no character
becomes U+FFFD.

Each document is its own row of work: no shuffle, memory bounded by a batch of
``BATCH`` characters (long texts are cut into runs where a piece begins), and the
vocabulary (under ``MAX_VOCAB_BYTES``, checked) is the only thing broadcast.

Defined results: null and empty texts have no tokens; very long texts are
encoded in runs; equal texts encode alike, repeated rows one by one; extra
columns are ignored; an empty table stays empty; null ids decode to an empty
text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import batches as text_batches
from quillgraph.llm.common import documents, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MAX_VOCAB_BYTES = 64 << 20
#: Bound of the transitions (and of the pairs of tokens) that one Python worker remembers.
MAX_TRANSITIONS = 600_000
#: Tokens below a node of the trie that are looked at in advance.
FEW = 4
#: Bytes of a piece that are read with the determinised table.
WIDTH = 64
#: A text is encoded in runs of so many pieces, or characters; a batch has so many characters.
PIECES, RUN, BATCH = 1 << 14, 1 << 16, 1 << 21
#: Ends of a text that are white space, or white space beside white space.
GAP = re.compile(r"^\s|\s\s|\s\Z")


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def merge(ranks: dict[bytes, int], data: bytes) -> list[bytes]:
    """The definition: join the adjacent pair of least rank, leftmost first, while one is in the vocabulary."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def ragged(off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and sizes of the rows ``which`` of a ragged array with bounds ``off``, row after row."""
    size = off[which + 1] - off[which]
    end = np.cumsum(size)
    return np.repeat(off[which] - (end - size), size) + np.arange(end[-1] if len(end) else 0), size


def bounds(size) -> np.ndarray:
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return out


class Transitions:
    """A hash table from (state, byte) to (state, number of what is emitted), asked by arrays."""

    def __init__(self):
        self.n, self.bits = 0, 16
        self._clear()

    def _clear(self) -> None:
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.to, self.out = (np.zeros(1 << self.bits, np.int32) for _ in range(2))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        at, mask = self._slot(key), (1 << self.bits) - 1
        met = self.key[at]
        open_ = np.flatnonzero(met != key)
        if len(open_):
            here = at[open_]
            met = met[open_]
            while len(open_):
                gone = met < 0
                at[open_[gone]] = -1
                open_, here = open_[~gone], (here[~gone] + 1) & mask
                met = self.key[here]
                hit = met == key[open_]
                at[open_[hit]] = here[hit]
                open_, here, met = open_[~hit], here[~hit], met[~hit]
        return at

    def add(self, key: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """Different keys that aren't in the table."""
        if (self.n + len(key)) * 2 > 1 << self.bits:
            old = np.flatnonzero(self.key >= 0)
            old = self.key[old], self.to[old], self.out[old]
            while (self.n + len(key)) * 2 > 1 << self.bits:
                self.bits += 1
            self.n = 0
            self._clear()
            self.add(*old)
        at, mask = self._slot(key), (1 << self.bits) - 1
        self.n += len(key)
        while len(key):
            free = np.flatnonzero(self.key[at] < 0)
            self.key[at[free]] = key[free]
            won = self.key[at] == key
            self.to[at[won]], self.out[at[won]] = to[won], out[won]
            key, to, out, at = key[~won], to[~won], out[~won], (at[~won] + 1) & mask


class Transducer:
    """BPE as a lazily determinised transducer: ``encode(bytes) -> tuple of ids``."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte is not in the vocabulary")
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        # the vocabulary's trie: an arc for each node and byte; whether a node has arcs; the token that ends there
        self.arc: dict[int, int] = {}
        self.deep, self.ends = [True], [-1]
        for b, i in ranks.items():
            node = 0
            for c in b:
                to = self.arc.get(node << 8 | c)
                if to is None:
                    to = self.arc[node << 8 | c] = len(self.ends)
                    self.deep[node] = True
                    self.deep.append(False)
                    self.ends.append(-1)
                node = to
            self.ends[node] = i
        # the tokens strictly below a node, if they are few
        below: list[list[int] | None] = [[] for _ in self.ends]
        for key, to in reversed(self.arc.items()):  # a node's arcs are older than those below it
            over, own = below[key >> 8], below[to]
            if over is not None:
                over += [] if own is None else own
                over += [self.ends[to]] if self.ends[to] >= 0 else []
                if own is None or len(over) > FEW:
                    below[key >> 8] = None
        self._below = below
        self._pair: dict[int, bool] = {}
        self._prospect: dict[int, int] = {}
        self._edges: dict[int, tuple] = {}
        self._reset()

    def _reset(self) -> None:
        #: a state is (last token sent, or -1 where it no longer matters, trie nodes, tokens pending before each);
        #: the last node is the root
        self._state: list[tuple] = []
        self._number: dict[tuple, int] = {}
        self._last: list[int] = []
        self._sent: dict[tuple[int, ...], int] = {(): 0}
        self.table = Transitions()
        self._start = self._id((-1, (0,), ((),)))

    def _id(self, state: tuple) -> int:
        if (n := self._number.get(state)) is None:
            n = self._number[state] = len(self._state)
            self._state.append(state)
            self._last.append(self._emission(state[2][-1]))
        return n

    def _emission(self, tokens: tuple[int, ...]) -> int:
        return self._sent.setdefault(tokens, len(self._sent))

    def _edge(self, token: int) -> tuple | None:
        """(left edge, right edge, steady): the tokens that stood at either end of ``token`` while it was
        merged, as (rank, bytes), single bytes first; steady if no merge had a lower rank than one before
        it. None if the merges don't lead to the token."""
        if token not in self._edges:
            data = self.token[token]
            own = None
            if len(data) == 1:
                own = ([(-1, data)], [(-1, data)], True)
            else:
                parts = merge(dict(self._inner(data)), data)
                if len(parts) == 2:
                    l, r = (self._edge(self.ranks[p]) for p in parts)
                    if l and r and merge(self.ranks, data) == [data]:
                        steady = l[2] and r[2] and token > l[0][-1][0] and token > r[0][-1][0]
                        own = ([*l[0], (token, data)], [*r[1], (token, data)], steady)
            self._edges[token] = own
        return self._edges[token]

    def _inner(self, data: bytes):
        """The vocabulary within ``data``, but not ``data`` itself."""
        n = len(data)
        for i in range(n):
            for j in range(i + 1, n + 1):
                if j - i < n and (r := self.ranks.get(data[i:j])) is not None:
                    yield data[i:j], r

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand after ``last`` (-1: at the start)."""
        key = last << 32 | token
        if (ok := self._pair.get(key)) is None:
            if len(self._pair) >= MAX_TRANSITIONS:
                self._pair.clear()
            ok = self._pair[key] = self._follows(last, token)
        return ok

    def _follows(self, last: int, token: int) -> bool:
        right = self._edge(token)
        if last < 0 or right is None:
            return right is not None
        left = self._edge(last)
        if not (left[2] and right[2]):
            return merge(self.ranks, self.token[last] + self.token[token]) == [
                self.token[last],
                self.token[token],
            ]
        # replay what happens at the boundary: a merge across it comes first if its rank is below the
        # next one on either side (on equal ranks the leftmost pair is merged)
        a, b, i, j, ranks = left[1], right[0], 0, 0, self.ranks
        while True:
            after_a = a[i + 1][0] if i + 1 < len(a) else 1 << 60
            after_b = b[j + 1][0] if j + 1 < len(b) else 1 << 60
            across = ranks.get(a[i][1] + b[j][1])
            if across is not None and across < after_a and across <= after_b:
                return False
            if after_a == after_b == 1 << 60:
                return True
            if after_a <= after_b:
                i += 1
            else:
                j += 1

    def _hope(self, last: int, node: int) -> int:
        """Which of the tokens below ``node`` may stand after ``last``: 0 none, 1 some, 2 all that may stand anywhere."""
        key = last << 32 | node
        if (hope := self._prospect.get(key)) is None:
            if len(self._prospect) >= MAX_TRANSITIONS:
                self._prospect.clear()
            own = [(self.follows(last, t), self.follows(-1, t)) for t in self._below[node]]
            hope = self._prospect[key] = 0 if not any(a for a, _ in own) else 2 if all(a == b for a, b in own) else 1
        return hope

    def _step(self, number: int, byte: int) -> tuple[int, int]:
        """The next state, and the number of what is emitted."""
        base, nodes, before = self._state[number]
        arc, deep, ends, below, hope = self.arc, self.deep, self.ends, self._below, self._hope
        to_nodes, to_before, done = [], [], None
        bound = False  # whether the last token sent still matters
        for node, pending in zip(nodes, before, strict=True):
            to = arc.get(node << 8 | byte)
            if to is None:
                continue
            last = pending[-1] if pending else base
            if deep[to] and (chance := hope(last, to) if below[to] is not None else 1):
                to_nodes.append(to)
                to_before.append(pending)
                bound = bound or (chance == 1 and not pending)
            if done is None and (token := ends[to]) >= 0 and self.follows(last, token):
                done = (*pending, token)
        to_nodes.append(0)
        to_before.append(done)
        sure = 0
        if to_before[0]:
            least = min(map(len, to_before))
            while sure < least and all(p[sure] == done[sure] for p in to_before):
                sure += 1
        if not sure:
            return self._id((base if bound else -1, tuple(to_nodes), tuple(to_before))), 0
        sent, rest = done[:sure], tuple([p[sure:] for p in to_before])
        # what was sent last matters to tokens that start right after it, unless all of those below may stand anywhere
        bound = any(not p and (below[n] is None or hope(sent[-1], n) == 1) for n, p in zip(to_nodes, rest, strict=True))
        return self._id((sent[-1] if bound else -1, tuple(to_nodes), rest)), self._emission(sent)

    def _finish(self, number: int, data: bytes) -> tuple[int, ...]:
        """What is emitted from a state on, without making further states."""
        base, nodes, before = self._state[number]
        arc, deep, ends, pair, follows = self.arc, self.deep, self.ends, self._pair, self.follows
        # a chain of tokens is (token, chain before); alive: trie node, chain up to the token's start
        alive = []
        for node, pending in zip(nodes, before, strict=True):
            chain_ = (base, None)
            for t in pending:
                chain_ = (t, chain_)
            alive.append((node, chain_))
        for byte in data:
            moved, done = [], None
            for node, so_far in alive:
                to = arc.get(node << 8 | byte)
                if to is None:
                    continue
                if deep[to]:
                    moved.append((to, so_far))
                token = ends[to]
                if done is None and token >= 0:
                    ok = pair.get(so_far[0] << 32 | token)
                    if follows(so_far[0], token) if ok is None else ok:
                        done = (token, so_far)
            moved.append((0, done))
            alive = moved
        out, at = [], alive[-1][1]
        while at[1] is not None:
            out.append(at[0])
            at = at[1]
        return tuple(out[::-1])

    def encode(self, data: bytes) -> tuple[int, ...]:
        return tuple(self.encode_all([data])[0].tolist())

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and their bounds."""
        if self.table.n >= MAX_TRANSITIONS:
            self._reset()
        whole = np.fromiter(map(self.ranks.get, pieces, [-1] * len(pieces)), np.int64, len(pieces))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rest = np.flatnonzero((whole < 0) & (size > 0))
        rest = rest[np.argsort(-size[rest], kind="stable")]
        at = bounds(size)[rest]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = size[rest]
        state = np.full(len(rest), self._start, np.int64)
        who, what = [], []
        for k in range(min(WIDTH, int(size[0])) if len(rest) else 0):
            n = int(np.searchsorted(-size, -k))  # pieces of more than k bytes
            key = state[:n] << 8 | data[at[:n] + k]
            slot = self.table.find(key)
            if (slot < 0).any():
                self._learn(key[slot < 0])
                slot = self.table.find(key)
            state[:n] = self.table.to[slot]
            sent = self.table.out[slot]
            some = np.flatnonzero(sent)
            who.append(some)
            what.append(sent[some])
        long = int(np.searchsorted(-size, -WIDTH))  # pieces of more than WIDTH bytes
        who.append(np.arange(len(rest)))
        tail = [self._emission(self._finish(int(state[i]), pieces[rest[i]][WIDTH:])) for i in range(long)]
        what.append(np.append(np.array(tail, np.int64), np.array(self._last, np.int64)[state[long:]]))
        # what single pieces send comes first, as emissions of one token
        flat = np.fromiter(chain.from_iterable(self._sent), np.int64)
        off = bounds(np.fromiter(map(len, self._sent), np.int64, len(self._sent)))
        who, what = np.concatenate(who), np.concatenate(what)
        order = np.argsort(who, kind="stable")
        who, what = who[order], what[order]
        place, sizes = ragged(off, what)
        ids = flat[place]
        total = np.zeros(len(pieces), np.int64)
        total[rest] = np.bincount(who, sizes, minlength=len(rest))
        single = whole >= 0
        own = bounds(np.bincount(np.arange(len(rest)), total[rest], minlength=len(rest)))
        total[single] = 1
        off = bounds(total)
        out = np.empty(int(off[-1]), np.int64)
        out[off[:-1][single]] = whole[single]
        n = np.diff(own)
        out[np.repeat(off[rest] - own[:-1], n) + np.arange(len(ids))] = ids
        return out, off

    def _learn(self, keys: np.ndarray) -> None:
        keys = np.unique(keys)
        made = [self._step(k >> 8, k & 255) for k in keys.tolist()]
        to, out = np.array(made, np.int32).T
        self.table.add(keys, to, out)


class Utf8Machine:
    """Incremental UTF-8: ``step(pending, bytes) -> (text, pending)``; bytes that can't belong to a
    character become U+FFFD one by one, and a character may be split over any number of steps."""

    @staticmethod
    def _need(first: int) -> tuple[int, int, int]:
        """Length of the character, and the range of its second byte."""
        if 0xC2 <= first <= 0xDF:
            return 2, 0x80, 0xBF
        if 0xE0 <= first <= 0xEF:
            return 3, 0xA0 if first == 0xE0 else 0x80, 0x9F if first == 0xED else 0xBF
        if 0xF0 <= first <= 0xF4:
            return 4, 0x90 if first == 0xF0 else 0x80, 0x8F if first == 0xF4 else 0xBF
        return (1, 0, 0) if first < 0x80 else (0, 0, 0)

    @classmethod
    def step(cls, pending: bytes, data: bytes) -> tuple[str, bytes]:
        out, held = [], pending
        for byte in data:
            if held:
                need, low, high = cls._need(held[0])
                if (low if len(held) == 1 else 0x80) <= byte <= (high if len(held) == 1 else 0xBF):
                    held += bytes([byte])
                    if len(held) == need:
                        value = held[0] & (0x7F >> need)
                        for b in held[1:]:
                            value = value << 6 | b & 0x3F
                        out.append(chr(value))
                        held = b""
                    continue
                out.append("�" * len(held))
                held = b""
            need = cls._need(byte)[0]
            if need == 1:
                out.append(chr(byte))
            elif need:
                held = bytes([byte])
            else:
                out.append("�")
        return "".join(out), held


#: States of the machine in arrays: 0 between characters, 1 to 3 that many bytes to come, 4 to 7 after E0, ED, F0
#: and F4, whose second bytes have ranges of their own, and 8 for what isn't UTF-8.
BAD = 8


def utf8_bytes() -> np.ndarray:
    """Next state by state and byte."""
    out = np.full((9, 256), BAD, np.uint8)
    out[0, :0x80], out[0, 0xC2:0xE0], out[0, 0xE0:0xF0], out[0, 0xF0:0xF5] = 0, 1, 2, 3
    out[0, 0xE0], out[0, 0xED], out[0, 0xF0], out[0, 0xF4] = 4, 5, 6, 7
    out[1, 0x80:0xC0], out[2, 0x80:0xC0], out[3, 0x80:0xC0] = 0, 1, 2
    out[4, 0xA0:0xC0], out[5, 0x80:0xA0], out[6, 0x90:0xC0], out[7, 0x80:0x90] = 1, 1, 2, 2
    return out


class Codec:
    """Text to ids and back."""

    def __init__(self, raw: bytes, pattern: str):
        import public_tokenizers
        import regex

        self.transducer = Transducer(read_ranks(raw))
        self.pattern = regex.compile(pattern)
        #: only of this pattern it is known that a piece begins at each single space
        self.spaced = pattern == public_tokenizers.PATTERN
        token = self.transducer.token
        most = max(token, default=-1) + 1
        own = [token.get(i, b"") for i in range(most)]
        self.off, self.data = bounds([len(b) for b in own]), np.frombuffer(b"".join(own), np.uint8)
        digits = [b"%d," % i for i in range(most)]
        self.digit_off, self.digits = bounds([len(b) for b in digits]), np.frombuffer(b"".join(digits), np.uint8)
        # the state machine lifted to tokens
        step, size = utf8_bytes(), np.diff(self.off)
        self.moves = np.repeat(np.arange(9, dtype=np.uint8)[None], most, 0)
        for k in range(int(size.max(initial=0))):
            some = np.flatnonzero(size > k)
            self.moves[some] = step[self.moves[some], self.data[self.off[some] + k][:, None]]

    # encoding

    def runs(self, text: str):
        """The text in runs of bounded length: (first run's head, words after single spaces) or a list of pieces.

        Where no two white-space characters meet, a piece of the pattern begins at each space, so words can be
        told apart by splitting at spaces and cut into pieces each by itself."""
        if not text:
            return
        if self.spaced and GAP.search(text) is None:
            at = 0
            while at < len(text):
                to = text.find(" ", at + RUN)
                to = len(text) if to < 0 else to
                words = text[at:to].split(" ") if at == 0 else text[at + 1 : to].split(" ")
                yield (self.pattern.findall(words[0]), words[1:]) if at == 0 else ([], words)
                at = to
        else:
            found = (m[0] for m in self.pattern.finditer(text)) if len(text) > RUN else iter(self.pattern.findall(text))
            while run := list(islice(found, PIECES)):
                yield run, []

    def encode_runs(self, runs: list[tuple[list[str], list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs, one after another, and their bounds."""
        words, pieces = defaultdict(count().__next__), defaultdict(count().__next__)
        # a word's number, or the complement of a piece's
        units = [[~pieces[p] for p in head] + [words[w] for w in rest] for head, rest in runs]
        of_runs = bounds([len(u) for u in units])
        units = np.fromiter(chain.from_iterable(units), np.int64, int(of_runs[-1]))
        found = self.pattern.findall(" " + " ".join(words)) if words else []
        lead = np.flatnonzero(np.fromiter((f[0] == " " for f in found), bool, len(found)))
        if len(lead) != len(words):
            raise ValueError("a word of the text doesn't begin a piece")
        found = np.array([pieces[f] for f in found], np.int64)
        ids, off = self.transducer.encode_all([p.encode("utf-8", "surrogatepass") for p in pieces])
        # pieces of the units: those of the words, then each piece by itself
        flat = np.append(found, np.arange(len(pieces)))
        first = np.concatenate([lead, len(found) + np.arange(len(pieces) + 1)])
        place, n = ragged(first, np.where(units < 0, len(words) + ~units, units))
        parts = flat[place]
        n = bounds(n)[of_runs]
        place, size = ragged(off, parts)
        return ids[place], bounds(size)[n]

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        out = [[] for _ in texts]
        for who, ids, off in self.batches(texts):
            for j, i in enumerate(who):
                out[i].append(ids[off[j] : off[j + 1]])
        return [np.concatenate([np.zeros(0, np.int64), *x]) for x in out]

    def batches(self, texts: list[str]):
        """(text of each run, ids, bounds of the runs) of bounded batches of runs."""
        who, runs, n = [], [], 0
        for i, text in enumerate(texts):
            for run in self.runs(text):
                who.append(i)
                runs.append(run)
                n += min(len(text), RUN)
                if n >= BATCH:
                    yield who, *self.encode_runs(runs)
                    who, runs, n = [], [], 0
        if runs:
            yield who, *self.encode_runs(runs)

    def decimals(self, ids: np.ndarray, off: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Decimal ids, a comma after each, and the bounds of the runs in them."""
        place, size = ragged(self.digit_off, ids)
        return memoryview(self.digits[place].tobytes()), bounds(size)[off]

    # decoding

    def decode_runs(self, ids: np.ndarray, off: np.ndarray) -> tuple[memoryview, np.ndarray, np.ndarray]:
        """Bytes of the ids of all runs, the bounds of the runs in them, and of each run whether it is whole UTF-8."""
        whole = np.ones(len(off) - 1, bool)
        # the machine rests between characters but within stretches of tokens that aren't whole characters
        part = np.flatnonzero(self.moves[ids, 0] != 0)
        if len(part):
            run = np.searchsorted(off, part, "right") - 1
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1] + 1) | (run[1:] != run[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(part)))
            order = np.argsort(-size, kind="stable")
            start, size = start[order], size[order]
            state = np.zeros(len(start), np.uint8)
            for k in range(int(size[0])):
                n = int(np.searchsorted(-size, -k))
                state[:n] = self.moves[ids[part[start[:n] + k]], state[:n]]
            whole[run[start[state != 0]]] = False
        place, size = ragged(self.off, ids)
        return memoryview(self.data[place].tobytes()), bounds(size)[off], whole

    def decode(self, ids: list[int]) -> str:
        data, _, whole = self.decode_runs(np.array(ids, np.int64), np.array([0, len(ids)]))
        if whole[0]:
            return str(data, "utf-8")
        text, pending = Utf8Machine.step(b"", bytes(data))
        return text + "\ufffd" * len(pending)


_CODECS: dict[tuple[bytes, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """One codec a Python worker; its memos serve all of the worker's tasks."""
    key = (hashlib.sha256(raw).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        raw = f.read(MAX_VOCAB_BYTES + 1)
    if len(raw) > MAX_VOCAB_BYTES:
        raise ValueError(f"the vocabulary is over {MAX_VOCAB_BYTES} bytes")
    return spark.sparkContext.broadcast(raw), pattern or public_tokenizers.PATTERN


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids, an array of int."""
    raw, pattern = _vocabulary(spark, path, pattern)

    def run(rows):
        import pyarrow as pa

        own = codec(raw.value, pattern)
        for part, _, _ in text_batches(rows, 1, BATCH):
            ids = pa.array(own.encode_texts([t or "" for t in part.column(1).to_pylist()]), pa.list_(pa.int32()))
            yield pa.record_batch([part.column(0), ids], names=["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(spark: SparkSession, encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give an empty text."""
    raw, pattern = _vocabulary(spark, path, None)

    def run(rows):
        import pyarrow as pa

        own = codec(raw.value, pattern)
        for batch in rows:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text = [own.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode, then decode what was encoded, in one pass."""
    raw, pattern = _vocabulary(spark, path, pattern)

    def run(rows):
        import pyarrow as pa

        own = codec(raw.value, pattern)

        def digests(texts: list[str]):
            n, of_ids, of_text = [0] * len(texts), {}, {}
            for who, ids, off in own.batches(texts):
                numbers, at = own.decimals(ids, off)
                data, to, whole = own.decode_runs(ids, off)
                if not whole.all():
                    raise ValueError("the ids of a run are no whole text")
                for j, i in enumerate(who):
                    if not n[i]:
                        of_ids[i], of_text[i] = hashlib.sha256(), hashlib.sha256()
                    elif off[j + 1] > off[j]:
                        of_ids[i].update(b",")
                    of_ids[i].update(numbers[at[j] : max(at[j], at[j + 1] - 1)])
                    of_text[i].update(data[to[j] : to[j + 1]])
                    n[i] += int(off[j + 1] - off[j])
            none = hashlib.sha256().hexdigest()
            return [n, *([h[i].hexdigest() if i in h else none for i in range(len(texts))] for h in (of_ids, of_text))]

        for part, _, _ in text_batches(rows, 1, BATCH):
            out = digests([t or "" for t in part.column(1).to_pylist()])
            columns = [part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "documents"))
