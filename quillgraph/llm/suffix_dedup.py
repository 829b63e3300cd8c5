"""Suffix-array dedup (10): threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte is removed if a 100-byte string of its document that covers it also
starts earlier in the corpus.  Candidates come from content-determined anchors
(see ``repeats``; here the 16-byte string of least hash in each 100 bytes).
Runs that share an anchor but differ are joined into a text whose transform is
expanded breadth first (the order of its suffixes looks at the next power of two of
bytes, so it doesn't tell which agree in 100): the interval of every string w of length l is extended
backwards by each byte c before it to the interval of cw, and a border that no
shorter string has set gets the common prefix l.  Values come in increasing
order, so expansion stops at 100: the borders never set are those of suffixes
that agree in 100 bytes or more, and the intervals between set borders are the
classes of equal 100-byte strings.

Defined results: null and empty texts, and texts under 100 bytes, keep all their
bytes; equal texts lose all but the first copy; see ``repeats`` for repeated and
null doc_ids; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import BYTE_CODE, OtherPowers, batches, mix, prefix_hash, range_hash, table
from quillgraph.llm.repeats import Method, covered_places, marked, versions, with_places

LENGTH = 100
#: Anchor length, and the context that keys a run: 42 bytes before the anchor, or 42 after it.
GRAM = 16
SIDE = (LENGTH - GRAM) // 2
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as little-endian numbers."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for j in range(8):
        m = (n - j + 7) // 8
        if m > 0:
            out[j::8] = np.frombuffer(data[j : j + 8 * m].tobytes(), "<u8")
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive entries."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def equal_windows(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Class numbers of the strings of ``length`` bytes at all positions of the circular text."""
    n = len(text)
    # the transform by doubling: an order of the suffixes by at least ``length`` bytes is all that expansion to
    # that length looks at. It has no borders of its own at that length: the expansion finds them
    rank, have = np.unique(_eights(np.resize(text, n + 7)).byteswap(), return_inverse=True)[1], 8
    while have < length:
        _, rank = np.unique(rank * np.int64(n + 1) + np.roll(rank, -have), return_inverse=True)
        have *= 2
    order = np.argsort(rank, kind="stable")
    before = text[order - 1]
    last_to_first = np.empty(n, np.int64)
    last_to_first[np.argsort(before, kind="stable")] = np.arange(n)
    starts = np.flatnonzero(np.diff(text[order], prepend=-1, append=256))  # of each byte's interval
    border = np.zeros(n + 1, bool)
    border[starts] = True
    byte_start = border.copy()
    lo, hi = starts[:-1], starts[1:]
    for _ in range(1, length):
        if not len(lo):
            break
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        to = last_to_first[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(len(which))]
        if len(to) * 8 > n:
            own = np.full(n + 1, -1, np.int64)
            own[to] = which
            change = (own[1:] != own[:-1]) | byte_start[1:]
            end = np.flatnonzero(change & (own[:-1] >= 0)) + 1
            begin = np.flatnonzero(np.concatenate([[True], change[:-1]]) & (own[:-1] >= 0))
        else:
            at = np.argsort(to)
            to, which = to[at], which[at]
            cut = (to[1:] != to[:-1] + 1) | (which[1:] != which[:-1]) | byte_start[to[1:]]
            begin = to[np.concatenate([[True], cut])]
            end = to[np.concatenate([cut, [True]])] + 1
        new = ~border[end]
        lo, hi = begin[new], end[new]
        border[hi] = True
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(border[:-1])
    return out


class Bytes(Method):
    length = LENGTH

    def runs(self, data, off):
        n = len(data)
        size = np.maximum(np.diff(off) - (LENGTH - 1), 0)
        if not size.sum():
            return (np.zeros(0, np.int64),) * 5
        eight = _eights(data)
        h = eight[: n - GRAM + 1] * _C1 + eight[8 : 8 + n - GRAM + 1] * _C2
        h ^= h >> np.uint64(29)
        h *= _C3
        bits = np.uint64(max(20, n.bit_length()))
        low = np.uint64((1 << int(bits)) - 1)
        least = _least(h & ~low | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
        text = np.repeat(np.arange(len(size)), size)
        start = np.arange(len(text)) + np.repeat(off[:-1] - (np.cumsum(size) - size), size)
        anchor = (least[start] & low).astype(np.int64)
        left = anchor - start >= SIDE
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(start)))
        text, start, anchor, left = text[at], start[at], anchor[at], left[at]
        table_ = prefix_hash(BYTE_CODE[data])
        key = range_hash(table_, np.where(left, anchor - SIDE, anchor), np.where(left, anchor + GRAM, anchor + GRAM + SIDE))
        key = np.where(left, mix(key), key)
        return text, start - off[text], count, key, range_hash(table_, start, start + count - 1 + LENGTH)

    def cut(self, data, off, text, start, count):
        begin = off[text] + start
        end = begin + count - 1 + LENGTH
        whole = data.tobytes()
        table_, other = prefix_hash(BYTE_CODE[data]), prefix_hash(mix(BYTE_CODE[data]), OtherPowers)

        def window(run, i):
            at = begin[run] + i
            return range_hash(table_, at, at + LENGTH), range_hash(other, at, at + LENGTH, OtherPowers)

        return [whole[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], window

    def compare(self, content, count):
        size = np.array([len(c) for c in content]) + 1
        # 0xFF is in no UTF-8 text
        classes = equal_windows(np.frombuffer(b"\xff".join(content) + b"\xff", np.uint8))
        first = np.cumsum(size) - size
        at = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
        own = classes[at]
        order = np.argsort(own, kind="stable")  # runs are in order of place
        later = np.zeros(len(own), bool)
        later[order[1:]] = own[order[1:]] == own[order[:-1]]
        return later


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary: the remaining bytes), n_bytes, n_removed and n_spans of every document."""

    def run(rows):
        import pyarrow as pa

        for part, data, off in batches(rows, 1):
            gone = marked(part, off, LENGTH)
            kept = ~gone
            total = np.concatenate([[0], np.cumsum(kept)])[off]
            edge = gone.copy()
            inner = off[1:-1][off[1:-1] < len(gone)]
            edge[1:] &= ~gone[:-1]
            edge[inner] = gone[inner]
            spans = np.diff(np.concatenate([[0], np.cumsum(edge)])[off])
            body = data[kept].tobytes()
            out = [body[a:b] for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]
            size = np.diff(off)
            yield pa.record_batch(
                [part.column(0), pa.array(out, pa.binary()), pa.array(size), pa.array(size - np.diff(total)), pa.array(spans)],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    rows, once = versions(spark, docs)
    return with_places(rows, covered_places(spark, once, Bytes())).mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = dedup(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
