"""Exact repeats of fixed-length windows over all documents: what substring and suffix-array dedup share.

A window is ``length`` consecutive units (bytes or words) of one document.  It
is *covered* if the same content also starts earlier (smaller doc_id, or the
same document and an earlier start).  A method supplies the anchors: for each
window one place inside it that its content alone determines, so equal windows
have their anchors at the same offset with the same surroundings.

1. Each task cuts the windows of its texts into runs of consecutive starts with
   the same anchor, and keys a run by its anchor's surroundings (more than half
   a window, which all windows of the run contain).  Within a slice of texts,
   runs of equal key and equal content are resolved at once: only the first goes
   on, so a passage in a third of all rows sends a row a slice, not a row a copy.
2. Runs are dealt by key and sorted by key, content and place; one streaming
   pass drops keys met once, marks runs whose whole content came earlier, and
   keeps one run of each different content where a key has several.
3. Those are cut out of the texts and compared by the method, whole keys at a
   time in bounded batches.  A key with more than HOT different runs would not
   be bounded: its runs are split into single windows dealt by their own
   content, where the first in order is kept: within the slice of texts, then
   in a streaming pass over what is first in a slice.  The content of a single
   window stands for itself by 128 bits, of two hashes with bases of their own;
   that of a run by the 128 bits of its key and its own hash.
4. The covered places of each document go back to its text.

All positions are kept; nothing is capped or sampled.  Rows with a null doc_id
are neither earlier than others nor cut.  Equal rows are one document, cut alike;
rows that share a doc_id but differ in text are documents of their own, in order
of a hash of their texts (their *version*, at most 2**23 a doc_id).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import batches, documents, materialize, mix, shuffle_partitions

#: Different runs of one key that are compared in one task at most, and bytes of a batch of keys.
HOT, BATCH_BYTES = 1000, 1 << 20
SALTS = 64
#: A place is version * VERSION + start * SPAN + number of starts.
SPAN = 256
VERSION = 1 << 40


class Method:
    """What an operator supplies; instances travel to the executors."""

    length: int

    def runs(self, data: np.ndarray, off: np.ndarray):
        """(text, start, count, key, content) of all runs; starts count from the text's own."""
        raise NotImplementedError

    def cut(self, data: np.ndarray, off: np.ndarray, text: np.ndarray, start: np.ndarray, count: np.ndarray):
        """(list of the runs' content as bytes, function (run, i) -> two 64-bit hashes of its i-th window)."""
        raise NotImplementedError

    def compare(self, content: list[bytes], count: np.ndarray) -> np.ndarray:
        """For runs in order of place: one boolean a window, run by run: whether it came earlier."""
        raise NotImplementedError


def _first_runs(method: Method, docs: DataFrame) -> DataFrame:
    def run(rows):
        import pyarrow as pa

        for part, data, off in batches(rows, 1):
            text, start, count, key, content = method.runs(data, off)
            if not len(text):
                continue
            ids = part.column(0).to_numpy(zero_copy_only=False)[text]
            place = part.column(2).to_numpy(zero_copy_only=False)[text] * VERSION + start.astype(np.int64) * SPAN + count
            order = np.lexsort((place, ids, content, key))
            key, content, ids, place = key[order], content[order], ids[order], place[order]
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
            # what is settled is dealt evenly
            key = np.where(again, mix(ids.astype(np.uint64) * np.uint64(31) + place.astype(np.uint64)), key)
            for i in range(0, len(key), 65536):
                s = slice(i, i + 65536)
                yield pa.record_batch(
                    [pa.array(key[s].view(np.int64)), pa.array(np.where(again, 0, content.view(np.int64))[s]), pa.array(ids[s]), pa.array(place[s]), pa.array(again[s])],
                    names=["key", "content", "doc_id", "place", "covered"],
                )

    return docs.mapInArrow(run, "key long, content long, doc_id long, place long, covered boolean")


def _stream(rows):
    """Step 2 over rows sorted by key, content, document and place."""
    import pyarrow as pa

    def out(key, ids, place, covered, which):
        return pa.record_batch(
            [pa.array(key[which]), pa.array(ids[which]), pa.array(place[which]), pa.array(covered[which])],
            names=["key", "doc_id", "place", "covered"],
        )

    held = None  # the last first-of-its-content row: key, content, doc_id, place, whether it was sent
    for batch in rows:
        if not batch.num_rows:
            continue
        key, content, ids, place = (batch.column(i).to_numpy() for i in range(4))
        done = batch.column(4).to_numpy(zero_copy_only=False)
        if done.any():
            yield out(key, ids, place, done, done)
            key, content, ids, place = (x[~done] for x in (key, content, ids, place))
            if not len(key):
                continue
        sent = np.zeros(len(key), bool)
        if held is not None:
            key, content, ids, place = (np.concatenate([[h], x]) for h, x in zip(held, (key, content, ids, place), strict=False))
            sent = np.concatenate([[held[4]], sent])
        same = key[1:] == key[:-1]
        first = np.ones(len(key), bool)
        first[1:] = ~(same & (content[1:] == content[:-1]))
        if not first.all():
            yield out(key, ids, place, ~first, ~first)
        k, c, d, p, s = (x[first] for x in (key, content, ids, place, sent))
        many = np.zeros(len(k), bool)
        many[1:] = k[1:] == k[:-1]
        many[:-1] |= k[1:] == k[:-1]
        many |= s
        now = many & ~s
        if now.any():
            yield out(k, d, p, ~many, now)
        held = (k[-1], c[-1], d[-1], p[-1], bool(many[-1]))


#: What a cut row is: a run to compare, a single window that is covered if its key came earlier, or covered windows.
RUN, SINGLE, SETTLED = 0, 1, 2


def _joined(place: np.ndarray, run: np.ndarray, j: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, place) of the stretches of covered windows; ``run`` and ``j`` number all windows, run by run."""
    at = np.flatnonzero(covered)
    run, j = run[at], j[at]
    new = np.ones(len(at), bool)
    new[1:] = (run[1:] != run[:-1]) | (j[1:] != j[:-1] + 1)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    run = run[begin]
    return run, (place[run] // SPAN + j[begin]) * SPAN + size


def _cut(method: Method):
    """Cut runs, given with their texts as (doc_id, text, array of (key, place, hot)), out of the texts.

    Runs of hot keys become single windows; those whose content came earlier in the slice are settled here, so
    a window in a third of all rows sends a row a slice."""

    def rows_of(state, key, ids, place, content):
        import pyarrow as pa

        state = pa.array(np.full(len(key), state, np.int32))
        columns = [state, pa.array(key), pa.array(ids), pa.array(place), content]
        return pa.record_batch(columns, names=["state", "key", "doc_id", "place", "run"])

    def run(rows):
        import pyarrow as pa

        for part, data, off in batches(rows, 1):
            runs = part.column(2)
            flat = runs.flatten()
            key = flat.field(0).to_numpy(zero_copy_only=False)
            place = flat.field(1).to_numpy(zero_copy_only=False)
            hot = flat.field(2).to_numpy(zero_copy_only=False).astype(bool)
            text = np.repeat(np.arange(part.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))
            ids = part.column(0).to_numpy()[text]
            content, window = method.cut(data, off, text, place % VERSION // SPAN, place % SPAN)
            cold = np.flatnonzero(~hot)
            for i in range(0, len(cold), 4096):
                w = cold[i : i + 4096]
                yield rows_of(RUN, key[w], ids[w], place[w], pa.array([content[x] for x in w], pa.binary()))
            which = np.flatnonzero(hot)
            count = (place % SPAN)[which]
            r = np.repeat(which, count)
            j = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            if not len(r):
                continue
            own, other = (h.view(np.int64) for h in window(r, j))
            at = (place[r] // SPAN + j) * SPAN + 1
            order = np.lexsort((at, ids[r], other, own))
            again = np.zeros(len(r), bool)
            again[order[1:]] = (own[order[1:]] == own[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
            first = np.flatnonzero(~again)
            for i in range(0, len(first), 65536):
                w = first[i : i + 65536]
                eights = np.arange(0, 8 * len(w) + 1, 8, dtype=np.int32)
                more = pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(eights), pa.py_buffer(other[w].tobytes())])
                yield rows_of(SINGLE, own[w], ids[r[w]], at[w], more)
            if again.any():
                run, places = _joined(place, r, j, again)
                ids = ids[run]
                # what is settled is dealt evenly
                dealt = mix(ids.astype(np.uint64) * np.uint64(31) + places.astype(np.uint64)).view(np.int64)
                yield rows_of(SETTLED, dealt, ids, places, pa.nulls(len(run), pa.binary()))

    return run


def _compare(method: Method):
    """Step 3 over cut rows sorted by state, key, content, document and place."""

    def settle(keys, ids, places, runs):
        import pyarrow as pa

        order = np.lexsort((places, ids))
        ids, places = ids[order], places[order]
        count = places % SPAN
        covered = method.compare([runs[i] for i in order], count)
        run = np.repeat(np.arange(len(count)), count)
        j = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        run, covered = _joined(places, run, j, covered)
        return pa.record_batch([pa.array(ids[run]), pa.array(covered)], names=["doc_id", "place"])

    def run(rows):
        import pyarrow as pa

        keys, ids, places, runs, size = [], [], [], [], 0
        single = None  # both hashes of the last single window
        for batch in rows:
            state = batch.column(0).to_numpy()
            if (state != RUN).any():
                key, doc, place = (batch.column(i).to_numpy() for i in range(1, 4))
                covered = state == SETTLED
                one = np.flatnonzero(state == SINGLE)
                if len(one):
                    both = np.stack([key[one], np.frombuffer(b"".join(batch.column(4).take(pa.array(one)).to_pylist()), np.int64)])
                    covered[one[1:]] = (both[:, 1:] == both[:, :-1]).all(0)
                    covered[one[0]] = single is not None and (both[:, 0] == single).all()
                    single = both[:, -1]
                yield pa.record_batch([pa.array(doc[covered]), pa.array(place[covered])], names=["doc_id", "place"])
                batch = batch.filter(pa.array(state == RUN))
            if not batch.num_rows:
                continue
            key, doc, place = (batch.column(i).to_numpy() for i in range(1, 4))
            body = batch.column(4).to_pylist()
            last = 0
            for cut in [*(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]:
                if size >= BATCH_BYTES and key[last] != keys[-1][-1]:
                    yield settle(None, np.concatenate(ids), np.concatenate(places), runs)
                    keys, ids, places, runs, size = [], [], [], [], 0
                keys.append(key[last:cut])
                ids.append(doc[last:cut])
                places.append(place[last:cut])
                runs += body[last:cut]
                size += sum(map(len, body[last:cut]))
                last = cut
        if runs:
            yield settle(None, np.concatenate(ids), np.concatenate(places), runs)

    return run


def versions(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, version) of all rows, and of each different one with a doc_id once."""
    docs = documents(docs)
    twice = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if not twice.limit(1).count():
        rows = docs.withColumn("version", F.lit(0).cast("long"))
        return rows, rows.where("doc_id IS NOT NULL")
    docs = docs.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    ranks = docs.select("doc_id", "hash").join(twice, "doc_id", "left_semi").distinct()
    ranks = ranks.withColumn("version", F.row_number().over(Window.partitionBy("doc_id").orderBy("hash")).cast("long") - 1)
    rows = docs.join(ranks, ["doc_id", "hash"], "left").select("doc_id", "text", F.coalesce("version", F.lit(0)).alias("version"))
    rows = materialize(spark, rows, "versions")
    once = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "version").agg(F.any_value("text").alias("text"))
    return rows, once.select("doc_id", "text", "version")


def covered_places(spark: SparkSession, docs: DataFrame, method: Method) -> DataFrame:
    """(doc_id, place): runs of covered window starts; every covered start is in at least one.

    ``docs`` are the different rows of ``versions``."""
    n = shuffle_partitions(spark)
    dealt = _first_runs(method, docs).repartition(n, "key")
    found = dealt.sortWithinPartitions("key", "content", "doc_id", "place").mapInArrow(
        _stream, "key long, doc_id long, place long, covered boolean"
    )
    found = materialize(spark, found, "repeats-found")
    open_ = found.where("NOT covered").select("key", "doc_id", "place")
    hot = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("hot"))
    # a hot key's rows meet it in SALTS tasks
    hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    open_ = open_.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    open_ = open_.join(hot, ["key", "salt"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    by_doc = open_.repartition(n, "doc_id").groupBy("doc_id", version()).agg(F.collect_list(F.struct("key", "place", "hot")).alias("runs"))
    # dealt by document, as in with_places: the same exchange of texts serves both
    cut = docs.join(by_doc.hint("merge"), ["doc_id", "version"]).select("doc_id", "text", "runs")
    cut = cut.mapInArrow(_cut(method), "state int, key long, doc_id long, place long, run binary").repartition(n, "key")
    cut = cut.sortWithinPartitions("state", "key", "run", "doc_id", "place").mapInArrow(_compare(method), "doc_id long, place long")
    return found.where("covered").select("doc_id", "place").unionByName(cut)


def version():
    return F.shiftright("place", 40).alias("version")


def with_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, text and places (array, maybe empty) of all ``rows`` of ``versions``, null doc_ids too."""
    places = places.repartition(shuffle_partitions(places.sparkSession), "doc_id")
    lists = places.groupBy("doc_id", version()).agg(F.collect_list("place").alias("places"))
    none = F.array().cast("array<long>")
    out = rows.where("doc_id IS NOT NULL").join(lists.hint("merge"), ["doc_id", "version"], "left")
    out = out.select("doc_id", "text", F.coalesce("places", none).alias("places"))
    return out.unionByName(rows.where("doc_id IS NULL").select("doc_id", "text", none.alias("places")))


def marked(part, units: np.ndarray, length: int) -> np.ndarray:
    """Booleans over the units of a slice (``units``: each text's first, one more at the end) that lie in
    covered windows; column 2 of the slice holds the places."""
    places = part.column(2)
    place = places.flatten().to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
    start = place % VERSION // SPAN + units[text]
    end = np.minimum(start + place % SPAN - 1 + length, units[text + 1])
    ok = start < end
    n = int(units[-1])
    step = np.bincount(start[ok], minlength=n + 1) - np.bincount(end[ok], minlength=n + 1)
    return np.cumsum(step[:-1]) > 0
