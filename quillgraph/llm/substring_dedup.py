"""Substring dedup (8): recompression of word sequences.

A word is removed if a window of 20 words that covers it also starts earlier in
the corpus.  Each round of recompression names runs of one symbol, then pairs of
a left-class and a right-class symbol; names and classes are hashes of what they
stand for, so every task gives equal content the same name without a shuffle.
Whether two neighbours are named together depends on them alone: in any window,
all symbols but a few at its ends are the same wherever it occurs.  The window's
anchor is the least-named of those certain symbols on the highest level that has
one (single words at worst); see ``repeats`` for how anchors are joined over
the corpus, and for the work that this saves.  Candidates are then verified word
by word.

Words are compared by 64-bit hashes of their bytes, windows by all their words.

Defined results: null, empty and blank texts have no words; texts under 20 words
keep them all; equal texts lose all but the first copy; see ``repeats`` for
repeated and null doc_ids; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import OtherPowers, batches, mix, prefix_hash, range_hash, table, word_hashes, word_spans
from quillgraph.llm.repeats import Method, covered_places, marked, versions, with_places

LENGTH = 20
ROUNDS = 2
#: Words beside the anchor that key a run with it.
SIDE = LENGTH // 2
_A, _B, _C = (mix(np.array([x], np.uint64))[0] | np.uint64(1) for x in (11, 12, 13))


class Level:
    """Symbols of one level: names, first words and texts; and the maps from the level below."""

    def __init__(self, name, start, text):
        self.name, self.start, self.text = name, start, text

    def up(self, number: int) -> tuple[Level, np.ndarray, np.ndarray]:
        """The next level; for a symbol that follows the unknown, the first certain symbol above, and for
        one that precedes the unknown, the end of the certain symbols above."""
        name, text = self.name, self.text
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
        run = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(name)))
        names = np.where(size > 1, mix(name[at] * _A + size.astype(np.uint64)), name[at])
        right = (mix(names + np.uint64(number) * _B) >> np.uint64(63)).astype(bool)
        pair = np.zeros(len(at), bool)
        pair[:-1] = ~right[:-1] & right[1:] & (text[at[1:]] == text[at[:-1]])
        second = np.zeros(len(at), bool)
        second[1:] = pair[:-1]
        symbol = np.append(np.cumsum(~second) - 1, (~second).sum())
        head = np.flatnonzero(~second)
        follow = np.minimum(head + 1, len(at) - 1)
        above = np.where(pair[head], mix(names[head] * _A + names[follow] * _C + _B), names[head])
        padded = np.append(right, False)
        after = run + 1
        lo = symbol[np.minimum(after + padded[np.minimum(after, len(at))], len(at))]
        before = np.maximum(run - 1, 0)
        hi = symbol[np.where(~right[before] & (run > 0), before, run)]
        return Level(above, self.start[at[head]], text[at[head]]), lo, hi


class Words(Method):
    length = LENGTH

    def _words(self, data, off):
        start, end, first = word_spans(data, off)
        return word_hashes(data, start, end), first

    def runs(self, data, off):
        words, first = self._words(data, off)
        size = np.maximum(np.diff(first) - (LENGTH - 1), 0)
        if not size.sum():
            return (np.zeros(0, np.int64),) * 5
        text = np.repeat(np.arange(len(size)), size)
        start = np.arange(len(text)) + np.repeat(first[:-1] - (np.cumsum(size) - size), size)
        level = Level(words, np.arange(len(words)), np.repeat(np.arange(len(size)), np.diff(first)))
        lo, hi = start, start + LENGTH
        anchor, name = np.empty(len(start), np.int64), np.empty(len(start), np.uint64)
        for number in range(ROUNDS + 1):
            some = lo < hi
            if number and not some.any():
                break
            at = self._least(level.name, lo[some], hi[some])
            anchor[some], name[some] = level.start[at], level.name[at] + np.uint64(number)
            if number < ROUNDS:
                level, up, down = level.up(number)
                last = len(up) - 1
                lo, hi = np.where(some, up[np.minimum(lo, last)], 1), np.where(some, down[np.clip(hi - 1, 0, last)], 0)
        left = anchor - start >= SIDE
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (text[1:] != text[:-1]) | (name[1:] != name[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(start)))
        text, start, anchor, left, name = text[at], start[at], anchor[at], left[at], name[at]
        table_ = prefix_hash(words)
        begin = np.where(left, anchor - SIDE, anchor)
        key = mix(range_hash(table_, begin, begin + SIDE + 1) + name * _C + left.astype(np.uint64))
        return text, start - first[text], count, key, range_hash(table_, start, start + count - 1 + LENGTH)

    @staticmethod
    def _least(name, lo, hi):
        """Place of the least name in [lo, hi), the first on ties; intervals are short."""
        bits = np.uint64(max(20, len(name).bit_length()))
        low = np.uint64((1 << int(bits)) - 1)
        rows = [mix(name) & ~low | np.arange(len(name), dtype=np.uint64)]
        while 2 ** len(rows) <= LENGTH:
            x, s = rows[-1], 2 ** (len(rows) - 1)
            y = x.copy()
            y[:-s] = np.minimum(x[:-s], x[s:])
            rows.append(y)
        k = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.uint64)
        for i, x in enumerate(rows):
            w = np.flatnonzero(k == i)
            out[w] = np.minimum(x[lo[w]], x[hi[w] - (1 << i)])
        return (out & low).astype(np.int64)

    def cut(self, data, off, text, start, count):
        words, first = self._words(data, off)
        begin = first[text] + start
        end = begin + count - 1 + LENGTH
        whole = words.tobytes()
        table_, other = prefix_hash(words), prefix_hash(mix(words), OtherPowers)

        def window(run, i):
            at = begin[run] + i
            return range_hash(table_, at, at + LENGTH), range_hash(other, at, at + LENGTH, OtherPowers)

        return [whole[8 * a : 8 * b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], window

    def compare(self, content, count):
        words = np.frombuffer(b"".join(content), np.uint64)
        size = np.array([len(c) // 8 for c in content])
        at = np.arange(count.sum()) + np.repeat(np.cumsum(size) - size - (np.cumsum(count) - count), count)
        # numbers of the words, of two of them, of four and so on up to a window: equal content, equal number
        own, have = np.unique(words, return_inverse=True)[1], 1
        while have < LENGTH:
            step = min(have, LENGTH - have)
            n = len(own) - step
            _, own = np.unique(own[:n] * np.int64(len(words) + 1) + own[step:], return_inverse=True)
            have += step
        own = own[at]
        order = np.argsort(own, kind="stable")  # runs are in order of place
        later = np.zeros(len(own), bool)
        later[order[1:]] = own[order[1:]] == own[order[:-1]]
        return later


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary: the kept words joined by one space), n_words and n_removed of every document."""

    def run(rows):
        import pyarrow as pa

        for part, data, off in batches(rows, 1):
            start, end, first = word_spans(data, off)
            keep = ~marked(part, first, LENGTH)
            out = data.copy()
            ink = np.zeros(len(data) + 1, np.int64)
            np.add.at(ink, start[keep], 1)
            np.add.at(ink, end[keep], -1)
            ink = np.cumsum(ink[:-1]) > 0
            # a space after each kept word but a text's last
            w = np.flatnonzero(keep)
            text = np.searchsorted(first, w, "right") - 1
            gap = end[w[:-1][text[1:] == text[:-1]]]
            out[gap] = 32
            ink[gap] = True
            total = np.concatenate([[0], np.cumsum(ink)])[off]
            body = out[ink].tobytes()
            kept = [body[a:b] for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]
            n = np.diff(first)
            gone = n - np.diff(np.concatenate([[0], np.cumsum(keep)])[first])
            yield pa.record_batch(
                [part.column(0), pa.array(kept, pa.binary()), pa.array(n), pa.array(gone)],
                names=["doc_id", "kept", "n_words", "n_removed"],
            )

    rows, once = versions(spark, docs)
    return with_places(rows, covered_places(spark, once, Words())).mapInArrow(run, "doc_id long, kept binary, n_words long, n_removed long")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(range(0, 20)) AS k)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
