"""Toxicity (7): votes of the nearest labelled examples by exact TF-IDF cosine.

Learned from labels: at most SAMPLE labelled rows (those whose document hashes
lowest; the bound is a parameter) give the examples, and all their words are the
terms of the space.  Document frequencies are counted over all documents.  A
term's weight is (1 + ln tf) * ln((N + 1) / (df + 1/2)) * (chi + 1) / (n + 1),
chi being the chi-square between label and presence among the n examples: a
weight above 0 for every term, no selection.  Vectors have length 1.

Search: posting lists of (example, weight).  A list of more than one in DENSE of
the examples is kept as a row of weights, zeros included, cut by blocks of BLOCK
examples with the largest weight in each; a shorter list is one block.  The
documents of a slice are searched together: short lists are added up, then the
FIRST blocks of highest upper bound are opened, then all whose bound reaches the
K-th best cosine found so far; an open block costs one product of the slice's
weights and the block's.  Cosines of all candidates within rounding of the K-th
are then taken anew in double precision, so the neighbours are exact; ties go to
the smaller doc_id.  An example is never its own neighbour.

Score: the distance-weighted vote, shrunk towards the rate of the label, (sum cos
* label + PRIOR * rate) / (sum cos + PRIOR), then calibrated: an isotonic fit of
the examples' labels on their own votes without themselves, shrunk to the rate by
one row a step and interpolated between steps.  Evidence lists the nearest
examples.

Only the index (the words of SAMPLE rows, each once a row) is collected and
broadcast; documents are read twice and never shuffled.

Defined results: words that no example has are left out of a document's vector; a
text without any term of the space (null and empty texts too) gets the rate among
such examples, so without labels 0; very long texts are whole vectors like
others; repeated doc_ids are scored one by one; a doc_id with several labels
counts as toxic if one is, and one with several texts is an example by the least
of them; null labels are ignored; extra columns are ignored.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import batches, documents, materialize, shuffle_partitions, table
from quillgraph.llm.decontaminate import tokens

SAMPLE = 8000
K, BLOCK, FIRST, PRIOR, DENSE = 16, 128, 4, 0.5, 24
#: What single precision may add to a cosine or take from it, as a share of it; no term is below 0.
MARGIN = 1e-4
#: Documents that are searched together.
SLICE = 128


def term_counts(data: np.ndarray, off: np.ndarray, terms: np.ndarray | None = None):
    """(text, term, tf) of all words, or of those in the sorted ``terms``, then as places in it."""
    words, first = tokens(data, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    if terms is None:
        order = np.lexsort((words, doc))
        doc, words = doc[order], words[order]
    else:
        if not len(terms) or not len(words):
            return (np.zeros(0, np.int64),) * 3
        seen = np.zeros(1 << 16, bool)
        seen[(terms >> np.uint64(48)).astype(np.int64)] = True
        near = np.flatnonzero(seen[(words >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(terms, words[near]), len(terms) - 1)
        hit = terms[at] == words[near]
        doc, words = doc[near[hit]], at[hit]
        order = np.lexsort((words, doc))
        doc, words = doc[order], words[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (words[1:] != words[:-1])
    start = np.flatnonzero(new)
    return doc[start], words[start], np.diff(np.append(start, len(doc)))


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each start and size, one after another."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class BlockMaxIndex:
    """Unit vectors of examples as posting lists, searched exactly by block maxima.

    vectors: an array of examples by terms, or (example, term, weight, number of terms) of what isn't 0."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors, block: int = BLOCK):
        if not isinstance(vectors, tuple):
            row, term = np.nonzero(vectors)
            vectors = row, term, vectors[row, term], vectors.shape[1]
        row, term, weight, self.size = vectors
        # examples alike in their heaviest term share blocks, which keeps the maxima sharp
        lead = np.full(len(ids), self.size)
        heavy = np.lexsort((term, -weight, row))
        heavy = heavy[np.unique(row[heavy], return_index=True)[1]]
        lead[row[heavy]] = term[heavy]
        order = np.lexsort((ids, labels, lead))
        self.ids, self.labels, self.block = ids[order], labels[order], block
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        row = place[row]
        # vectors by example, and by term
        order = np.lexsort((term, row))
        self.term, self.weight = term[order].astype(np.int32), weight[order]
        self.of_example = np.searchsorted(row[order], np.arange(len(ids) + 1))
        self._lists = None

    def lists(self):
        """(bounds, examples, weights) of the short lists; each term's dense row or -1; rows; block maxima."""
        if self._lists is None:
            n = len(self.ids)
            example = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.of_example))
            df = np.bincount(self.term, minlength=self.size)
            dense = np.flatnonzero(df * DENSE > n)
            row = np.full(self.size, -1)
            row[dense] = np.arange(len(dense))
            wide = -(-n // self.block) * self.block
            rows = np.zeros((len(dense), wide), np.float32)
            of = row[self.term]
            rows[of[of >= 0], example[of >= 0]] = self.weight[of >= 0]
            maxima = rows.reshape(len(dense), -1, self.block).max(2) if wide else rows
            short = np.flatnonzero(of < 0)
            short = short[np.argsort(self.term[short], kind="stable")]
            first = np.searchsorted(self.term[short], np.arange(self.size + 1))
            self._lists = first, example[short], self.weight[short].astype(np.float32), row, rows, maxima
        return self._lists

    def __getstate__(self):
        return self.__dict__ | {"_lists": None}

    @property
    def filled(self) -> np.ndarray:
        """Whether an example has any term."""
        return np.diff(self.of_example) > 0

    @property
    def vectors(self) -> np.ndarray:
        """The array of examples, in the order of ids, by terms; for small indexes."""
        out = np.zeros((len(self.ids), self.size))
        out[np.repeat(np.arange(len(self.ids)), np.diff(self.of_example)), self.term] = self.weight
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = K, without: int | None = None):
        """(places, cosines) of the k nearest examples of positive cosine, ties by smaller id."""
        return self.nearest_all(np.zeros(len(terms), np.int64), terms, weights, [without], k)[0]

    def nearest_all(self, doc: np.ndarray, terms: np.ndarray, weights: np.ndarray, without: list, k: int = K):
        """``nearest`` of several documents, given as (document, term, weight) in order of document."""
        first, example, weight, row, rows, maxima = self.lists()
        n, many, block = len(self.ids), len(without), self.block
        own = row[terms]
        # short lists in full
        short = own < 0
        t, d, w = terms[short], doc[short], weights[short].astype(np.float32)
        size = first[t + 1] - first[t]
        at = spans(first[t], size)
        wide = rows.shape[1]
        cells = np.repeat(d * wide, size) + example[at]
        c = np.bincount(cells, np.repeat(w, size) * weight[at], minlength=many * wide).astype(np.float32).reshape(many, wide)
        # long lists by blocks
        asked = np.zeros((many, len(rows)), np.float32)
        asked[doc[~short], own[~short]] = weights[~short]
        bound = c.reshape(many, -1, block).max(2) + asked @ maxima if wide else c
        myself = np.searchsorted(self.ids_sorted[0], [-1 if x is None else x for x in without]) if n else []
        hidden = []
        for i, (x, j) in enumerate(zip(without, myself, strict=False)):
            if x is not None and j < n and self.ids_sorted[0][j] == x:
                hidden.append((i, self.ids_sorted[1][j]))
        closed = np.ones(bound.shape, bool)

        def open_(which: np.ndarray) -> None:
            for b in np.flatnonzero(which.any(0)):
                some = np.flatnonzero(which[:, b])
                s = slice(b * block, (b + 1) * block)
                c[some, s] += asked[some] @ rows[:, s]
            closed[which] = False

        def kth() -> np.ndarray:
            """The k-th best cosine among what is open, or 0."""
            for i, j in hidden:
                c[i, j] = 0
            if n <= k:
                return np.zeros(many, np.float32)
            best = np.where(np.repeat(closed, block, 1), 0, c)[:, :n]
            return -np.partition(-best, k - 1, axis=1)[:, k - 1]

        if len(rows):
            which = np.zeros(bound.shape, bool)
            np.put_along_axis(which, np.argpartition(-bound, min(FIRST, bound.shape[1] - 1), 1)[:, :FIRST], True, 1)
            open_(which)
            open_(closed & (bound * np.float32(1 + MARGIN) >= kth()[:, None]))
        else:
            closed[:] = False
        least = kth()
        out, begin = [], np.searchsorted(doc, np.arange(many + 1))
        query = np.zeros(self.size)
        c[np.repeat(closed, block, 1)] = 0
        for i in range(many):
            place = np.flatnonzero((c[i, :n] > 0) & (c[i, :n] >= least[i] * np.float32(1 - MARGIN)))
            t = terms[begin[i] : begin[i + 1]]
            query[t] = weights[begin[i] : begin[i + 1]]
            size = self.of_example[place + 1] - self.of_example[place]
            at = spans(self.of_example[place], size)
            exact = np.bincount(np.repeat(np.arange(len(place)), size), query[self.term[at]] * self.weight[at], minlength=len(place))
            exact = np.round(exact, 9)
            query[t] = 0
            order = np.lexsort((self.ids[place], -exact))[:k]
            order = order[exact[order] > 0]
            out.append((place[order], exact[order]))
        return out

    @cached_property
    def ids_sorted(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.ids)
        return self.ids[order], order


def isotonic(vote: np.ndarray, label: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """A rising curve (votes, chances) through the labels: neighbouring steps that fall are pooled, each
    step is shrunk towards the rate by one row, and the curve reaches on to either end."""
    steps: list[list[float]] = []
    for x, y in sorted(zip(vote.tolist(), label.tolist(), strict=True)):
        if steps and steps[-1][1] / steps[-1][0] == x:  # equal votes are one step
            n, sx, sy = steps.pop()
            steps.append([n + 1, sx + x, sy + y])
        else:
            steps.append([1, x, y])
        while len(steps) > 1 and steps[-2][2] * steps[-1][0] >= steps[-1][2] * steps[-2][0]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
    n, x, y = (np.array(c) for c in zip(*steps, strict=True))
    x, y = x / n, np.maximum.accumulate((y + rate) / (n + 1))
    return np.concatenate([[min(0.0, x[0])], x, [max(1.0, x[-1])]]), np.concatenate([[y[0] / 2], y, [(1 + y[-1]) / 2]])


class Model:
    """idf: a term's weight but for its count; curve: from votes to chances, if there is one."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, index: BlockMaxIndex):
        self.terms, self.idf, self.index, self.curve = terms, idf, index, None
        y = index.labels
        self.rate = float(y.mean()) if len(y) else 0.0
        blank = ~index.filled
        self.blank = float((y[blank].sum() + self.rate) / (blank.sum() + 1)) if len(y) else 0.0

    def votes(self, doc: np.ndarray, terms: np.ndarray, tf: np.ndarray, ids: list) -> tuple[np.ndarray, list[str]]:
        """Vote and evidence of each document; nan where it has no term of the space."""
        weights = (1 + np.log(tf)) * self.idf[terms]
        length = np.sqrt(np.bincount(doc, weights**2, minlength=len(ids)))
        weights = weights / np.where(length > 0, length, 1)[doc]
        value, evidence = np.full(len(ids), np.nan), [""] * len(ids)
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        for a in range(0, len(ids), SLICE):
            b = min(a + SLICE, len(ids))
            s = slice(cut[a], cut[b])
            found = self.index.nearest_all(doc[s] - a, terms[s], weights[s], ids[a:b])
            for i, (place, cosine) in enumerate(found, a):
                if length[i] > 0:
                    vote = float((cosine * self.index.labels[place]).sum())
                    value[i] = (vote + PRIOR * self.rate) / (float(cosine.sum()) + PRIOR)
                    evidence[i] = ",".join(f"{j}:{c:.3f}" for j, c in zip(self.index.ids[place[:3]], cosine[:3], strict=True))
        return value, evidence

    def score(self, doc: np.ndarray, terms: np.ndarray, tf: np.ndarray, ids: list) -> tuple[np.ndarray, list[str]]:
        value, evidence = self.votes(doc, terms, tf, ids)
        known = ~np.isnan(value)
        out = np.full(len(ids), self.blank)
        out[known] = value[known] if self.curve is None else np.interp(value[known], *self.curve)
        return out, evidence

    def calibrate(self, vote: np.ndarray, label: np.ndarray) -> None:
        if len(vote):
            self.curve = isotonic(vote, label, self.rate)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """``labels``: (doc_id, toxic) of the rows to learn from."""
    docs = documents(docs)
    named = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = materialize(spark, chosen.select(F.col("doc_id").cast("long"), F.col("toxic").cast("long")), "toxic-sample")

    def count(rows):
        import pyarrow as pa

        for part, data, off in batches(rows, 1):
            doc, word, tf = term_counts(data, off)
            own = pa.array(doc)
            yield pa.record_batch(
                [part.column(0).take(own), part.column(2).take(own), pa.array(word.view(np.int64)), pa.array(tf)],
                names=["doc_id", "toxic", "term", "tf"],
            )

    # at most ``sample`` rows of two numbers
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    texts = materialize(spark, texts.repartition(shuffle_partitions(spark), "doc_id"), "toxic-texts")
    found = materialize(spark, texts.mapInArrow(count, "doc_id long, toxic long, term long, tf long"), "toxic-terms")
    # at most ``sample`` rows, and a row for each of their words
    examples = texts.select("doc_id", "toxic").orderBy("doc_id").collect()
    ids, labels = (np.array([r[c] for r in examples], np.int64) for c in ("doc_id", "toxic"))
    rows = found.select("doc_id", "term", "tf").toArrow()
    doc_id, term, tf = (rows.column(c).to_numpy() for c in range(3))
    del rows
    row = np.searchsorted(ids, doc_id)
    words, term = np.unique(term.view(np.uint64), return_inverse=True)
    n1, n = float(labels.sum()), len(ids)
    n0 = n - n1
    every = np.bincount(term, minlength=len(words)).astype(float)
    a = np.bincount(term, labels[row], minlength=len(words))
    b = every - a
    chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / (every * (n - every) * max(n1 * n0, 1) + 1e-9)

    known = spark.sparkContext.broadcast(words)

    def frequencies(rows):
        import pyarrow as pa

        total, n = np.zeros(len(known.value), np.int64), 0
        for part, data, off in batches(rows, 1):
            n += part.num_rows
            _, at, _ = term_counts(data, off, known.value)
            total += np.bincount(at, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(-1, some)), pa.array(np.append(n, total[some]))], names=["at", "n"])

    counts = docs.mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n")).toArrow()
    df = np.zeros(len(words) + 1)
    df[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    idf = np.log((df[-1] + 1) / (df[:-1] + 0.5)) * (chi + 1) / (n + 1)
    weight = (1 + np.log(tf)) * idf[term]
    length = np.sqrt(np.bincount(row, weight**2, minlength=n))
    vectors = (row, term, weight / np.where(length > 0, length, 1)[row], len(words))
    model = Model(words, idf, BlockMaxIndex(ids, labels.astype(float), vectors))
    votes = _judged(spark, texts, model, Model.votes).where("NOT isnan(score)").select("doc_id", "score").toArrow()
    # at most ``sample`` rows of two numbers
    model.calibrate(votes.column(1).to_numpy(), labels[np.searchsorted(ids, votes.column(0).to_numpy())])
    return model


def _judged(spark: SparkSession, docs: DataFrame, model: Model, judge) -> DataFrame:
    held = spark.sparkContext.broadcast(model)

    def run(rows):
        import pyarrow as pa

        own = held.value
        for part, data, off in batches(rows, 1):
            doc, at, tf = term_counts(data, off, own.terms)
            value, evidence = judge(own, doc, at, tf, part.column(0).to_pylist())
            yield pa.record_batch(
                [part.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(evidence, pa.string())],
                names=["doc_id", "score", "predicted", "evidence"],
            )

    return documents(docs).mapInArrow(run, "doc_id long, score double, predicted int, evidence string")


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and evidence, one row a document."""
    return _judged(spark, docs, model, Model.score)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = fit(spark, docs, table(spark, sf_dir, "labels").where(~held_out))
    out = score(spark, docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")
