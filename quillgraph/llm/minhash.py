"""MinHash near-dedup (2) with sequential Bayesian verification.

Words are lower-cased (A-Z); a document's set is its distinct SHINGLE-word
shingles, or the whole sequence as one where it is shorter.  Documents with equal
sets become one node, so copies cost nothing further.  Signatures of BANDS * ROWS
minima are banded; two sets of similarity 0.8 miss every band with probability
(1 - 0.8**ROWS)**BANDS, under 4e-6.  Candidate pairs are compared by batches of the
signature, and dropped once the posterior probability (uniform prior) that their
similarity reaches 0.8 is under MISS; survivors are verified on their full sets.

Links only have to be found between components, so pairs are never expanded
within a bucket.  First each member is compared with the bucket's least node.
Buckets whose members are then in one component are done.  In the others, members
of different components are compared inside the task, in cells of bounded size (a
larger bucket becomes pairs of its parts, each a cell): pruned by their signatures,
verified on their sets, and joined as soon as a link is found, so that a cell sends
at most one link a member and no pair of different components stays unverified.

Defined results: null, empty and blank texts have empty sets and are linked with
nothing; rows that share a doc_id are one document, which joins the links of their
sets; a null doc_id is linked with nothing and kept, its component null; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import batches, documents, materialize, mix, table, word_hashes, word_spans

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
BATCH, MISS = 32, 1e-6
CELL = 1024

_XOR = mix(np.arange(1000, 1000 + SIZE, dtype=np.uint64))
_MUL = mix(np.arange(5000, 5000 + SIZE, dtype=np.uint64)) | np.uint64(1)
_WORD = mix(np.arange(9000, 9000 + 64, dtype=np.uint64)) | np.uint64(1)


def least_matches(seen: int, miss: float = MISS) -> int:
    """Fewest equal minima of ``seen`` with which a pair goes on: P(similarity >= 0.8) >= miss."""
    t, total = PERCENT / 100, 0.0
    for m in range(seen + 1):
        # the posterior is Beta(m + 1, seen - m + 1); its upper tail is a binomial one
        total += comb(seen + 1, m) * t**m * (1 - t) ** (seen + 1 - m)
        if total >= miss:
            return m
    return seen


NEED = [(n, least_matches(n)) for n in range(BATCH, SIZE + 1, BATCH)]


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE):
    """(shingles, first): the sorted distinct shingle hashes of each text, one after the other."""
    start, end, first = word_spans(data, off)
    words = word_hashes(data, start, end, fold_case=True)
    n = np.diff(first)
    count = np.maximum(n - shingle + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(text)) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    h = np.zeros(len(at), np.uint64)
    padded = np.append(words, np.zeros(shingle, np.uint64))
    for i in range(shingle):
        inside = at + i < first[text + 1]
        h += np.where(inside, padded[at + i], np.uint64(i)) * _WORD[i]
    h = mix(h)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SIZE minima (32 bits) of each text; zeros for empty sets."""
    out = np.zeros((len(first) - 1, SIZE), np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for j in range(SIZE):
            out[some, j] = np.minimum.reduceat((sets ^ _XOR[j]) * _MUL[j], first[some]) >> np.uint64(32)
    return out


def _sketch(rows, shingle: int):
    import pyarrow as pa

    for part, data, off in batches(rows, 1):
        sets, first = shingle_sets(data, off, shingle)
        sig = signatures(sets, first)
        body = sig.tobytes()
        width = SIZE * 4
        yield pa.record_batch(
            [
                part.column(0),
                pa.array(np.diff(first)),
                pa.array(_sums(mix(sets), first).view(np.int64)),
                pa.array(_sums(mix(sets ^ _XOR[0]), first).view(np.int64)),
                pa.array([body[i * width : (i + 1) * width] for i in range(len(sig))], pa.binary()),
            ],
            names=["doc_id", "n", "k1", "k2", "sig"],
        )


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIZE)


def _bands(rows):
    import pyarrow as pa

    for batch in rows:
        sig = _matrix(batch.column(1)).astype(np.uint64).reshape(-1, BANDS, ROWS)
        h = (sig * _WORD[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _MUL[0]
        keys = mix(h).view(np.int64)
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(nodes, BANDS))], names=["bucket", "node"])


def _prune(rows):
    """Keep the pairs whose signatures pass every batch."""
    import pyarrow as pa

    for batch in rows:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            if not part.num_rows:
                continue
            x, y = _matrix(part.column(2)), _matrix(part.column(3))
            alive, seen = np.arange(len(x)), np.zeros(len(x), np.int64)
            for n, need in NEED:
                seen[alive] += (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(axis=1)
                alive = alive[seen[alive] >= need]
            yield pa.record_batch([part.column(j).take(pa.array(alive)) for j in (0, 1)], names=["a", "b"])


def _cells(t):
    """Links that join components within one cell: pairs of members of different components, pruned by
    batches of their signatures and verified on full sets; what a link joins is one component from then on."""
    import pyarrow as pa

    node, comp, own = (t.column(c).to_numpy() for c in ("node", "comp", "own"))
    x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
    order = np.argsort(node, kind="stable")
    node, own = node[order], own[order]
    label = np.unique(comp[order], return_inverse=True)[1]
    sig = _matrix(t.column("sig").combine_chunks())[order]
    items = t.column("items").to_pylist()
    sets = [np.frombuffer(items[i], np.uint64) for i in order]
    size = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(size)])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(known), bool)
    out_a, out_b = [], []
    for i in range(len(node)):
        if x != y and own[i] != x:
            continue
        c = np.flatnonzero(label != label[i])
        c = c[c > i] if x == y else c[own[c] != own[i]]
        c = c[100 * np.minimum(size[c], size[i]) >= PERCENT * np.maximum(size[c], size[i])]
        seen = np.zeros(len(c), np.int64)
        for n, need in NEED:
            seen += (sig[c, n - BATCH : n] == sig[i, n - BATCH : n]).sum(axis=1)
            c, seen = c[seen >= need], seen[seen >= need]
        if not len(c):
            continue
        mine = flat[first[i] : first[i + 1]]
        mark[mine] = True
        ends = np.cumsum(size[c])
        at = np.arange(ends[-1]) + np.repeat(first[c] - (ends - size[c]), size[c])
        common = np.add.reduceat(mark[flat[at]].astype(np.int64), ends - size[c])
        mark[mine] = False
        c = c[100 * common >= PERCENT * (size[c] + size[i] - common)]
        labels, at = np.unique(label[c], return_index=True)
        out_a += np.minimum(node[i], node[c[at]]).tolist()
        out_b += np.maximum(node[i], node[c[at]]).tolist()
        label[np.isin(label, labels)] = label[i]
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _sets(rows, shingle: int):
    import pyarrow as pa

    for part, data, off in batches(rows, 1):
        sets, first = shingle_sets(data, off, shingle)
        key = _sums(mix(sets), first).view(np.int64)
        body = sets.tobytes()
        out = [body[8 * i : 8 * j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.record_batch([part.column(0), pa.array(key), pa.array(out, pa.binary())], names=["node", "k1", "items"])


def _verify(rows):
    import pyarrow as pa

    for batch in rows:
        good = []
        for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
                continue
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= PERCENT * (len(both) - common):
                good.append(i)
        yield pa.record_batch([batch.column(j).take(pa.array(good, pa.int64())) for j in (0, 1)], names=["a", "b"])


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable over links (a, b), for all nodes that have one.

    Least labels travel along links and are shortcut through the label's own label, so rounds grow with
    the logarithm of a chain's length; each round's labels are written."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = materialize(spark, edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("comp"))
    labels = materialize(spark, labels, "labels")
    while True:
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("comp").alias("near"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", "comp", F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        step = step.join(jump, "new", "left").select("node", "comp", F.least("new", F.coalesce("far", "new")).alias("new"))
        step = materialize(spark, step, "labels")
        changed = step.where("new <> comp").limit(1).count()
        labels = step.select("node", F.col("new").alias("comp"))
        if not changed:
            return labels


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row a document; sets are of ``shingle`` words."""
    docs = documents(docs)
    sketches = materialize(spark, docs.mapInArrow(lambda rows: _sketch(rows, shingle), "doc_id long, n long, k1 long, k2 long, sig binary"), "sketches")
    keyed = sketches.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "k1", "k2")
    nodes = keyed.agg(F.min("doc_id").alias("node"), F.any_value("sig").alias("sig"))
    nodes = materialize(spark, nodes, "nodes")
    bands = nodes.select("node", "sig").mapInArrow(_bands, "bucket long, node long")
    buckets = bands.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("c"), F.min("node").alias("pivot"), F.bit_xor(F.xxhash64("node")).alias("same")
    )
    # bands that gather the same nodes are one bucket
    buckets = buckets.where("c > 1").groupBy("c", "pivot", "same").agg(F.min("bucket").alias("bucket"))
    members = bands.join(buckets, "bucket").where("node <> pivot").select("bucket", "pivot", "node", "c")
    members = materialize(spark, members, "members")
    sig = nodes.select("node", "sig")

    def pruned(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "x"}), "a")
        both = both.join(sig.withColumnsRenamed({"node": "b", "sig": "y"}), "b").select("a", "b", "x", "y")
        return both.mapInArrow(_prune, "a long, b long")

    def sets_of(named: DataFrame) -> DataFrame:
        named = named.distinct().join(nodes.select("node", "k1"), "node")
        texts = docs.join(named.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
        sets = texts.mapInArrow(lambda rows: _sets(rows, shingle), "node long, k1 long, items binary").join(named, ["node", "k1"], "left_semi")
        return sets.select("node", "items")

    star = members.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = materialize(spark, pruned(star), "pairs")
    # all that is left to verify: texts are dealt once, for the pairs of the star and the larger buckets
    wanted = star.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = wanted.unionByName(members.where("c > 2").select(F.explode(F.array("pivot", "node")).alias("node")))
    sets = materialize(spark, sets_of(wanted), "sets")
    both = star.join(sets.withColumnsRenamed({"node": "a", "items": "x"}), "a")
    both = both.join(sets.withColumnsRenamed({"node": "b", "items": "y"}), "b").select("a", "b", "x", "y")
    links = materialize(spark, both.mapInArrow(_verify, "a long, b long"), "links")
    several = sketches.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    several = several.where("rows > 1").select("doc_id")
    if several.limit(1).count():
        own = sketches.select("doc_id", "n", "k1", "k2").join(several, "doc_id").join(nodes.select("n", "k1", "k2", "node"), ["n", "k1", "k2"])
        own = own.select(F.least("doc_id", "node").alias("a"), F.greatest("doc_id", "node").alias("b")).where("a < b").distinct()
        links = links.unionByName(materialize(spark, own, "links"))
    comps = components(spark, links)
    whole = members.select("bucket", "node").unionByName(members.select("bucket", F.col("pivot").alias("node")).distinct())
    placed = whole.join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    open_ = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    # the star has compared the two members of a bucket of two
    open_ = open_.where("lo < hi AND m > 2").select("bucket", F.ceil(F.col("m") / CELL).cast("int").alias("parts"))
    left = placed.join(open_, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    left = materialize(spark, left, "open")
    if left.limit(1).count():
        # a part meets every part: the cell of a part with itself, and one for each pair of parts
        cells = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cells = cells.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
        cells = cells.join(sig, "node").join(sets, "node")
        cells = cells.select("bucket", "x", "y", "own", "node", "comp", "sig", "items")
        found = cells.groupBy("bucket", "x", "y").applyInArrow(_cells, "a long, b long").distinct()
        comps = components(spark, links.unionByName(materialize(spark, found, "links")))
    placed = nodes.select("n", "k1", "k2", "node").join(comps, "node", "left")
    placed = placed.select("n", "k1", "k2", F.coalesce("comp", "node").alias("comp"))
    out = sketches.drop("sig").join(placed, ["n", "k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS t FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON r.t = e.a)
SELECT d AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(t) AS component_id, d = min(t) AS kept
FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d
"""
