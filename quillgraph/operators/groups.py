"""Passes over small groups of rows (a function each), many groups to an Arrow batch.

Rows are dealt and sorted by their key and read as a stream, so a group costs no batch of its own.  Groups that are
equal but for a shift of their ids have one shape, and a task computes a shape once: its result is shifted back for
every group that has it.  Shapes are compared whole, never by hash; what is kept of them is bounded (``KEPT``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

#: Bytes of shapes and number of words that a task keeps before it starts afresh.
KEPT, WORDS = 64 << 20, 1 << 20


def by_shape(df: DataFrame, keys: list[str], run: Callable[[list[dict]], list[tuple]], schema: str, ids: list[str], base: str | None = None, lists: list[str] = (), words: list[str] = (), shifted: list[str] = (), order: list[str] = ()) -> DataFrame:
    """``keys`` (text, long) and ``schema`` of what ``run`` makes of the rows of each group.

    ids: columns of longs, lists: of lists of longs; both are given to ``run`` less the least ``base`` of the group
    (as they are without), which is added again to the columns ``shifted`` of its result.  words: columns of texts.
    order: columns by which rows of equal ``base`` are sorted, for rows that are to make equal shapes."""
    columns = [*dict.fromkeys([*ids, *lists, *words])]
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [x.split()[1] for x in schema.split(", ")]

    def whole(batches: Iterator) -> Iterator:
        """Tables of whole groups."""
        import pyarrow as pa
        import pyarrow.compute as pc

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = [batch.column(c) for c in keys]
            end = tuple(c[-1].as_py() for c in k)
            if last is not None and end == last and tuple(c[0].as_py() for c in k) == last:
                held.append(batch)
                continue
            same = [pc.fill_null(pc.equal(c, c[-1]), False) if c[-1].is_valid else pc.is_null(c) for c in k]
            inside = same[0]
            for s in same[1:]:
                inside = pc.and_(inside, s)
            at = pc.index(inside, True).as_py()
            yield pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks()
            held, last = [batch.slice(at)], end
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def stream(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        types = [{"string": pa.string(), "long": pa.int64()}[k] for k in kinds]
        shapes, codes, kept = {}, {}, 0
        flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c

        def coded(column):
            """Numbers of the texts, equal for equal ones while ``codes`` is kept."""
            d = flat(column.dictionary_encode())
            own = np.array([codes.setdefault(x, len(codes)) for x in d.dictionary.to_pylist()] + [-1], dtype=np.int64)
            return own[pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False)]

        for t in whole(batches):
            n = t.num_rows
            if not n:
                continue
            if kept > KEPT or len(codes) > WORDS:
                shapes, codes, kept = {}, {}, 0
            parts, below, differ = [], [], np.zeros(n, dtype=bool)
            for c in keys:
                d = flat(t.column(c).dictionary_encode()).indices
                d = pc.fill_null(d, -1).to_numpy(zero_copy_only=False)
                differ[1:] |= d[1:] != d[:-1]
            starts = np.concatenate([[0], np.flatnonzero(differ)])
            sizes = np.diff(np.append(starts, n))
            first = np.zeros(len(starts), dtype=np.int64)
            if base is not None:
                first = flat(t.column(base)).to_numpy(zero_copy_only=False)[starts]
            shift = np.repeat(first, sizes)
            for c in ids:
                v = flat(t.column(c))
                empty = v.is_null().to_numpy(zero_copy_only=False)
                parts += [np.where(empty, 0, pc.fill_null(v, 0).to_numpy(zero_copy_only=False) - shift), empty.astype(np.int64)]
            parts += [coded(t.column(c)) for c in words]
            for c in lists:
                v = flat(t.column(c))
                size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(size)])
                inner = v.flatten()
                inner = np.where(inner.is_null().to_numpy(zero_copy_only=False), -(1 << 63), pc.fill_null(inner, 0).to_numpy(zero_copy_only=False) - np.repeat(shift, size))
                below.append((inner, at))
                parts.append(size)
            matrix = np.ascontiguousarray(np.column_stack(parts))
            found = []
            for s, size, b in zip(starts.tolist(), sizes.tolist(), first.tolist(), strict=True):
                e = s + size
                shape = b"".join([matrix[s:e].tobytes(), *[v[at[s] : at[e]].tobytes() for v, at in below]])
                hit = shapes.get(shape)
                if hit is None:
                    rows = t.slice(s, size).select(columns).to_pylist()
                    for r in rows:
                        for c in ids:
                            r[c] = None if r[c] is None else r[c] - b
                        for c in lists:
                            r[c] = [None if x is None else x - b for x in r[c] or []]
                    out = list(zip(*run(rows), strict=True)) or [()] * len(names)
                    hit = shapes[shape] = [pa.array(c, ty) for c, ty in zip(out, types, strict=True)]
                    kept += len(shape) + 8 * len(names) * len(hit[0])
                found.append(hit)
            lengths = np.array([len(h[0]) for h in found])
            if not lengths.sum():
                continue
            to, back = pa.array(np.repeat(starts, lengths)), pa.array(np.repeat(first, lengths))
            made = [flat(t.column(c)).take(to) for c in keys]
            for k, name in enumerate(names):
                column = pa.concat_arrays([h[k] for h in found])
                made.append(pc.add(column, back) if name in shifted else column)
            yield pa.RecordBatch.from_arrays(made, names=[*keys, *names])

    given = df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *([base] if base else ids), *order)
    return given.mapInArrow(stream, f"{keys[0]} string, {keys[1]} long, {schema}")
