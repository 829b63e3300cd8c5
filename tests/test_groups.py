"""Passes over groups: equal shapes once, groups across batches, ancestors in and across functions."""

import random

from quillgraph.operators import closure, groups


def test_equal_shapes_are_computed_once_and_shifted_back(spark, tmp_path):
    # 3000 groups of two shapes and one of 25,000 rows, which spans Arrow batches
    rows = [("f", g, g * 1000 + i, [g * 1000 + i + 1, None] if g % 2 else None, "w") for g in range(3000) for i in range(3)]
    rows += [("big", 7, -i, [], None) for i in range(25_000)]
    df = spark.createDataFrame(rows, "file string, fn long, id long, below array<long>, word string")
    marks = str(tmp_path)

    def run(given):
        import uuid

        open(f"{marks}/{uuid.uuid4().hex}", "w").close()
        return [(r["id"], (r["below"] or [None])[0], len(given), r["word"]) for r in given]

    out = groups.by_shape(df, ["file", "fn"], run, "id long, next long, size long, word string", ["id"], "id", ["below"], ["word"], ["id", "next"])
    got = sorted((r.file, r.fn, r.id, r.next, r.size, r.word) for r in out.collect())
    want = [("f", g, g * 1000 + i, g * 1000 + i + 1 if g % 2 else None, 3, "w") for g in range(3000) for i in range(3)]
    want += [("big", 7, -i, None, 25_000, None) for i in range(25_000)]
    assert got == sorted(want, key=lambda x: x[:3])
    # a group that isn't shared with another is one more call
    assert len(list(tmp_path.iterdir())) <= 3 * 16


def test_ancestors_by_brute_force(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for f in ("a", "b"):
        up = {i: rng.choice([None, *range(max(0, i - 5), i)]) if i % 17 else None for i in range(300)}
        # functions are nested, some nodes are in none, and one function's nodes are torn apart
        fn = {i: rng.choice([None, i // 20, i // 20, 99]) for i in up}
        rows += [(f, i, p, fn[i]) for i, p in up.items()]
        for i in up:
            p, d = up[i], 1
            while p is not None:
                want.add((f, p, i, d))
                p, d = up[p], d + 1
    tree = spark.createDataFrame(rows, "file string, id long, parent_id long, function_id long")
    got = [tuple(r) for r in closure.ancestors(spark, tree).select("file", "anc", "desc", "depth").collect()]
    assert len(got) == len(set(got)) and set(got) == want
