"""Benchmark decontamination (3): spaced-seed hashing.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased.  Each
mask of MASKS looks at four words of a span and ignores those between; together
they hit every stretch of STRETCH words that differs from a benchmark item in at
most STRETCH - LEAST words (tests/llm checks this for every placing of the
differences).  An item under STRETCH words is also cut into one run of words more
than may differ, so one run of it stands unchanged in every match; its runs are
seeds too.  Seed hashes of the benchmark are joined with those of all
training positions; each hit names a diagonal, along which item and document
are compared word by word.  A pair is reported if some stretch of STRETCH words
(or the whole item, if shorter; then all but one in five words) agrees in at
least LEAST; an item under five words must agree in all.  Substituted words are tolerated; nothing is capped or sampled.

The benchmark is a stated query set: it is read in blocks of at most
BLOCK_WORDS words, each of which is broadcast (a few MB at most) and joined with
all documents in one pass without a shuffle of texts; more items than a block
mean more passes.  Only the hits, by (document, item), are aggregated.

Defined results: null, empty and short texts (fewer words than the item's
stretch) match nothing; items without words match nothing; repeated rows of a
doc_id or item_id give one row for the pair with its best stretch, the first in
the text on ties; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import BYTE_CODE, batches, documents, mix, prefix_hash, range_hash, table

MASKS = ("111011", "110100101", "111000101")
STRETCH, LEAST = 13, 10
BLOCK_WORDS = 500_000
#: Runs of an item under STRETCH words: masks of so many words, after MASKS.
RUNS = ("1", "11", "111", "1111", "11111")

_KIND = np.zeros(256, bool)
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SALT = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_OFFSETS = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in MASKS + RUNS]


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first (one more at the end)."""
    ink = np.zeros(len(data) + 2, bool)
    ink[1:-1] = _KIND[data]
    left, right = ink[1:-1] & ~ink[:-2], ink[1:-1] & ~ink[2:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    left[inner] = ink[inner + 1]
    right[inner - 1] = ink[inner]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return range_hash(prefix_hash(BYTE_CODE[_FOLD[data]]), start, end), np.searchsorted(start, off)


def seeds(words: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of mask k at each position where it fits, and those positions; ends: of each word's text."""
    o = _OFFSETS[k]
    n = len(words) - int(o[-1])
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, np.uint64(k))
    for c, i in zip(_SALT, o, strict=False):
        h += words[i : i + n] * c
    at = np.flatnonzero(np.arange(n) + o[-1] < ends[:n])
    return mix(h)[at], at


class Index:
    """Seeds of one block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.words, self.first = tokens(np.frombuffer(b"".join(raw), np.uint8), off)
        self.ids = np.array(ids, np.int64)
        size = np.diff(self.first)
        item = np.repeat(np.arange(len(ids)), size)
        ends = np.repeat(self.first[1:], size)
        self.tables = []
        runs = self._runs(size)
        for k in range(len(_OFFSETS)):
            h, at = seeds(self.words, ends, k)
            if k >= len(MASKS):
                own = np.isin(at, runs[k - len(MASKS)])
                h, at = h[own], at[own]
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            seen = np.zeros(1 << 22 if len(h) else 0, bool)
            seen[(h >> np.uint64(42)).astype(np.int64)] = True
            self.tables.append((h, at, item[at] if len(at) else at, seen))

    def _runs(self, size: np.ndarray) -> list[np.ndarray]:
        """Where the runs of each length start in the items under STRETCH words."""
        out = [[np.zeros(0, np.int64)] for _ in RUNS]
        for n in range(1, STRETCH):
            first, begin = self.first[:-1][size == n], 0
            for part in np.array_split(np.arange(n), n // 5 + 1):
                out[len(part) - 1].append(first + begin)
                begin += len(part)
        return [np.concatenate(x) for x in out]

    def hits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, start, matches, compared): the best stretch of each text and item that pass."""
        words, first = tokens(data, off)
        ends = np.repeat(first[1:], np.diff(first))
        found = []
        for k, (h, at, item, seen) in enumerate(self.tables):
            if not len(h):
                continue
            own, pos = seeds(words, ends, k)
            if not len(own):
                continue
            near = np.flatnonzero(seen[(own >> np.uint64(42)).astype(np.int64)])
            lo, hi = np.searchsorted(h, own[near], "left"), np.searchsorted(h, own[near], "right")
            some = hi > lo
            lo, count, p = lo[some], (hi - lo)[some], pos[near[some]]
            which = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            p = np.repeat(p, count)
            found.append(np.stack([item[which], p - (at[which] - self.first[item[which]]), np.searchsorted(first, p, "right") - 1]))
        if not sum(x.shape[1] for x in found):
            return (np.zeros(0, np.int64),) * 5
        item, begin, doc = np.unique(np.concatenate(found, axis=1), axis=1)
        out = [self._verify(words, first, item[i : i + 4096], begin[i : i + 4096], doc[i : i + 4096]) for i in range(0, len(item), 4096)]
        doc, item, start, match, span = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((start, -match, item, doc))
        doc, item, start, match, span = (x[order] for x in (doc, item, start, match, span))
        best = np.ones(len(doc), bool)
        best[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        return doc[best], self.ids[item[best]], start[best], match[best], span[best]

    def _verify(self, words, first, item, begin, doc):
        """Slide the stretch along each diagonal; begin: where the item's first word would stand."""
        size = np.diff(self.first)[item]
        longest = max(int(size.max()), STRETCH)
        k = np.arange(longest)
        at = begin[:, None] + k
        inside = (k < size[:, None]) & (at >= first[doc][:, None]) & (at < first[doc + 1][:, None])
        same = np.zeros(at.shape, bool)
        rows, cols = np.nonzero(inside)
        same[rows, cols] = words[at[rows, cols]] == self.words[self.first[item[rows]] + cols]
        total = np.zeros((len(item), longest + 1), np.int64)
        np.cumsum(same, axis=1, out=total[:, 1:])
        span = np.minimum(size, STRETCH)
        # the stretch starts where it ends within the item
        s = np.arange(longest)
        e = np.minimum(s + span[:, None], longest)
        agree = np.where(s + span[:, None] <= size[:, None], np.take_along_axis(total, e, 1) - total[:, :-1], -1)
        best = agree.argmax(axis=1)
        match = agree[np.arange(len(item)), best]
        need = np.where(size >= STRETCH, LEAST, size - size // 5)
        ok = match >= need
        start = np.maximum(begin + best, first[doc]) - first[doc]
        return doc[ok], item[ok], start[ok], match[ok], span[ok]


def _blocks(benchmark: DataFrame):
    """(ids, texts) of at most BLOCK_WORDS words each, one item at least; only one block is held."""
    ids, texts, words = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len((row["text"] or "").split())
        if ids and words + n > BLOCK_WORDS:
            yield ids, texts
            ids, texts, words = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        words += n
    yield ids, texts


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (word of the document), n_match and n_words of the best stretch."""
    out = None
    for ids, texts in _blocks(benchmark.where("item_id IS NOT NULL")):
        index = spark.sparkContext.broadcast(Index(ids, texts))

        def run(rows, index=index):
            import pyarrow as pa

            for part, data, off in batches(rows, 1):
                doc, item, start, match, span = index.value.hits(data, off)
                if len(doc):
                    own = part.column(0).take(pa.array(doc))
                    yield pa.record_batch(
                        [own, *(pa.array(x.astype(np.int64)) for x in (item, start, match, span))],
                        names=["doc_id", "item_id", "start", "n_match", "n_words"],
                    )

        part = documents(docs).mapInArrow(run, "doc_id long, item_id long, start long, n_match long, n_words long")
        out = part if out is None else out.unionByName(part)
    best = F.min(F.struct((-F.col("n_match")).alias("_m"), "start", "n_match", "n_words")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.start", "b.n_match", "b.n_words")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any reported overlap, with all their columns."""
    bad = overlaps(spark, docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
