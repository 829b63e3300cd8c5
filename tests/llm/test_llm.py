"""Every operator against a brute-force version on a small table of odd rows."""

import hashlib
import itertools
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import bpe, decontaminate, licenses, minhash, quality, repeats, sharding, substring_dedup, suffix_dedup, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, place long, g string, comp long, kept boolean"
WORD = r"[^\x20\x09-\x0D]+"


def corpus():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)] + ["é%d" % i for i in range(20)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(120), say(60)
    near = base.split()
    near[7] = "changed"
    texts = [
        None, "", " \n\t", "one", "a b c", base, base, " ".join(near), base.upper(), say(30) + " " + passage + " " + say(30),
        passage + "\n" + say(80), say(10) + "\t" + passage, "a " * 300, "a " * 300 + "b", "ab" * 400, say(6000),
        passage * 3, "line x\nline x\n\nline y\nline x", "日本語 " * 60, "Licensed under the Apache License, Version 2.0.",
        say(70) + " " + passage[:150], *(say(90) for _ in range(8)),
    ]
    texts += [" ".join(w if rng.random() > 0.04 else rng.choice(words) for w in base.split()) for _ in range(30)]
    return [(i * 3 % 97, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    out = [(i, t, None, None if i % 5 == 0 else f"s{i % 3}", len(t or ""), 1, 2, "x", 3, None) for i, t in rows]
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("hot", [1000, 0])
def test_suffix_dedup(spark, rows, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    got, seen = by_id(suffix_dedup.dedup(spark, docs)), set()
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))))
        assert bytes(got[i]["kept"]) == kept
    assert suffix_dedup.dedup(spark, empty).count() == 0


def test_substring_dedup_and_hot_keys(spark, rows, docs, monkeypatch):
    for hot in (1000, 0):
        monkeypatch.setattr(repeats, "HOT", hot)
        got, seen = by_id(substring_dedup.dedup(spark, docs)), set()
        for i, t in sorted(rows, key=lambda r: r[0]):
            w = re.findall(WORD, t or "")
            gone = [False] * len(w)
            for s in range(len(w) - 19):
                k = tuple(w[s : s + 20])
                if k in seen:
                    gone[s : s + 20] = [True] * 20
                seen.add(k)
            kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
            assert (got[i]["n_words"], got[i]["n_removed"], bytes(got[i]["kept"]).decode()) == (len(w), sum(gone), kept)


def test_repeated_doc_ids(spark):
    rng = random.Random(8)
    a, b = (" ".join("w%d" % rng.randrange(500) for _ in range(n)) for n in (150, 70))
    rows = [(1, a), (1, a), (2, a), (3, b + " " + a[:300]), (3, "short"), (4, None), (None, a), (7, b), (7, "x " + b), (7, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("version", F.lit(3))

    def gone(df, n):
        return sorted(((r["doc_id"] or 0, r[n], r["n_removed"]) for r in df.collect()))

    size = len(a.encode())
    got = gone(suffix_dedup.dedup(spark, docs), "n_bytes")
    assert [x for x in got if x[0] in (0, 1, 2)] == [(0, size, 0), (1, size, 0), (1, size, 0), (2, size, size)]
    assert [x[2] for x in got if x[0] == 3] == [0, 300] and (4, 0, 0) in got
    assert [x[2] for x in got if x[0] == 7] == [len(b)] * 3
    got = gone(substring_dedup.dedup(spark, docs), "n_words")
    assert [x for x in got if x[0] in (0, 1, 2)] == [(0, 150, 0), (1, 150, 0), (1, 150, 0), (2, 150, 150)]
    assert [x[2] for x in got if x[0] == 7] == [70] * 3
    near = spark.createDataFrame([(1, a), (2, a), (2, b), (5, b), (None, b), (None, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark, near).collect()]
    assert sorted(x for x in got if x[0]) == [(1, 1, True), (2, 1, False), (2, 1, False), (5, 1, False)]
    assert [x for x in got if not x[0]] == [(None, None, True)] * 2


def test_equal_windows():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(97, 100, 300), rng.integers(97, 100, 300)]).astype(np.uint8)
    text[300:450] = text[20:170]
    classes = suffix_dedup.equal_windows(text, 40)
    ring = np.concatenate([text, text]).tobytes()
    own = [ring[i : i + 40] for i in range(len(text))]
    for i, j in itertools.combinations(range(0, 600, 7), 2):
        assert (classes[i] == classes[j]) == (own[i] == own[j])
    assert classes[20] == classes[300]


def test_near_duplicates(spark, rows, docs, empty):
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))} if w else set()
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            lo, hi = sorted((label[a], label[b]))
            label = {k: lo if v == hi else v for k, v in label.items()}
    got = by_id(minhash.near_duplicates(spark, docs))
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), label[i], label[i] == i), i
    assert minhash.near_duplicates(spark, empty).count() == 0


def test_bayes_bounds():
    assert [n for n, _ in minhash.NEED] == [32, 64, 96]
    assert all(0.4 < need / n < 0.75 for n, need in minhash.NEED)


def test_quality(spark, rows, docs, empty):
    got = by_id(quality.quality_rules(spark, docs))
    for i, t in rows:
        t = t or ""
        w = re.findall(WORD, t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 2000 else None
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        r = got[i]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t) and r["n_dup_lines"] == len(lines) - len(set(lines))
        if covered is not None:
            assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(w) < 50 or 100 * r["n_repeat_words"] > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(spark, empty).count() == 0


def test_codec_equals_tiktoken(rows):
    import public_tokenizers as P
    import tiktoken

    raw = open(P.path(bpe.VOCABULARY), "rb").read()
    ranks = bpe.read_ranks(raw)
    own, theirs = bpe.Codec(raw, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [t or "" for _, t in rows] + ["<|endoftext|>", " 's", "x  y", "\n\na b "]
    texts += ["".join(rng.choice("abcdeé日🙂 \n'#1\t") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    # pieces beyond the determinised width, texts of many runs with and without spare white space, repeated texts
    letters = "".join(rng.choice("abcdeéß日") for _ in range(3000))
    texts += ["x" * 500, letters, f"{letters} {letters}", "0" * 200, "w é%d " % 5 * 30000 + "end", "w  x\n" * 40000, *texts[:9]]
    for t in texts:
        ids = own.encode(t)
        assert ids == theirs.encode_ordinary(t) and own.decode(ids) == t
    for last, token in [(rng.choice(range(50000)), rng.choice(range(50000))) for _ in range(2000)]:
        pair = own.transducer.token[last], own.transducer.token[token]
        assert own.transducer.follows(last, token) == (bpe.merge(ranks, pair[0] + pair[1]) == list(pair))


def test_codec_of_other_patterns_and_bounds(monkeypatch):
    import public_tokenizers as P
    import tiktoken

    raw = open(P.path(bpe.VOCABULARY), "rb").read()
    pattern = r"\S+\s\S+|\s+|\S+"  # pieces hold single spaces
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(raw), special_tokens={})
    texts = ["one two three", "a b", " lead", "x" * 90 + " y", "", "tail "]
    own = bpe.Codec(raw, pattern)
    assert [x.tolist() for x in own.encode_texts(texts)] == [theirs.encode_ordinary(t) for t in texts]
    # transitions that are dropped again and again, and tiny batches, change nothing
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 50)
    monkeypatch.setattr(bpe, "BATCH", 10)
    monkeypatch.setattr(bpe, "RUN", 8)
    monkeypatch.setattr(bpe, "WIDTH", 3)
    own = bpe.Codec(raw, P.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(raw), special_tokens={})
    texts += ["many words in a longer text of several runs" * 5, "a  b" * 20]
    assert [x.tolist() for x in own.encode_texts(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_codec_decodes_any_ids():
    import public_tokenizers as P

    own = bpe.Codec(open(P.path(bpe.VOCABULARY), "rb").read(), P.PATTERN)
    rng = random.Random(8)
    single = [own.transducer.ranks[bytes([b])] for b in range(256)]
    for _ in range(300):
        ids = [rng.choice(single) for _ in range(rng.randint(0, 12))]
        data = b"".join(own.transducer.token[i] for i in ids)
        whole = own.decode_runs(np.array(ids, np.int64), np.array([0, len(ids)]))[2][0]
        try:
            assert own.decode(ids) == data.decode() and whole
        except UnicodeDecodeError:
            text, held = bpe.Utf8Machine.step(b"", data)
            assert own.decode(ids) == text + "\ufffd" * len(held) and not whole


def test_utf8_machine():
    text = "aé日🙂"
    pending, out = b"", ""
    for b in text.encode():
        piece, pending = bpe.Utf8Machine.step(pending, bytes([b]))
        out += piece
    assert out == text and pending == b""
    assert bpe.Utf8Machine.step(b"", b"\xffa\xc3b") == ("�a�b", b"")


def test_round_trip(spark, rows, docs, empty):
    got = by_id(bpe.round_trip(spark, docs))
    for i, t in rows:
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    ids = by_id(bpe.encode(spark, docs))
    assert all(got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[i]["ids"])).encode()).hexdigest() for i, _ in rows)
    assert bpe.round_trip(spark, empty).count() == 0


def test_masks_hit_all_stretches():
    offsets = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    for gone in itertools.combinations(range(decontaminate.STRETCH), decontaminate.STRETCH - decontaminate.LEAST):
        same = set(range(decontaminate.STRETCH)) - set(gone)
        assert any(all(s + o in same for o in off) for off in offsets for s in range(decontaminate.STRETCH - off[-1]))


def test_decontamination(spark, rows, docs, empty):
    item = next(t for i, t in rows if t and len(t.split()) == 120).split()[20:50]
    item[4], item[11] = "other", "words"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "never seen words here at all in any text of this table")], "item_id long, text string")
    found = decontaminate.overlaps(spark, docs, bench).collect()
    want = set()
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for s in range(len(w) - 12):
            if any(sum(a == b for a, b in zip(w[s : s + 13], item[k : k + 13], strict=True)) >= 10 for k in range(len(item) - 12)):
                want.add((i, 1))
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and want
    assert decontaminate.overlaps(spark, docs, bench.limit(0)).count() == 0
    assert decontaminate.overlaps(spark, empty, bench).count() == 0


def test_sharding(spark, rows, docs, empty):
    got = sharding.shard(spark, docs, 4).collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(4)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    text = dict(rows)
    for r in got:
        t = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
    assert sharding.shard(spark, empty).count() == 0


def test_block_max_is_exact():
    rng = np.random.default_rng(1)
    vectors = rng.random((300, 20)) * (rng.random((300, 20)) < 0.2)
    ids = rng.permutation(300)
    index = toxicity.BlockMaxIndex(ids, rng.integers(0, 2, 300).astype(float), vectors, block=16)
    for _ in range(50):
        terms = np.sort(rng.choice(20, 4, replace=False))
        q = rng.random(4)
        place, cosine = index.nearest(terms, q, k=7)
        c = np.round(index.vectors[:, terms] @ q, 9)
        best = np.lexsort((index.ids, -c))[:7]
        best = best[c[best] > 0]
        assert index.ids[place].tolist() == index.ids[best].tolist() and np.allclose(cosine, c[best])


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["calm", "day", "tree", "sun"]) for _ in range(20)) + (" vile scum" if i % 3 == 0 else "")) for i in range(200)]
    own = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 200, 2)] + [(1, None)], "doc_id long, toxic int")
    model = toxicity.fit(spark, own, labels)
    got = by_id(toxicity.score(spark, own, model))
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i, _ in texts)
    nothing = toxicity.fit(spark, own, labels.limit(0))
    assert {r["score"] for r in toxicity.score(spark, docs, nothing).collect()} == {0.0}
    assert toxicity.score(spark, empty, model).count() == 0
    few = toxicity.fit(spark, own, spark.createDataFrame([(1, 0), (3, 1), (None, 1), (4, None), (9999, 1)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(spark, docs, few).collect()} == {few.blank}


def test_short_items():
    # every placing of the words that may differ, in items of every length under the stretch
    for n in range(1, decontaminate.STRETCH):
        item = [f"i{n}x{j}" for j in range(n)]
        index, texts = decontaminate.Index([7], [" ".join(item)]), []
        for m in range(n // 5 + 2):
            for gone in itertools.combinations(range(n), m):
                texts.append((m, " ".join(["left", *("other" if j in gone else w for j, w in enumerate(item)), "right"])))
        data = [t.encode() for _, t in texts]
        off = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
        doc, ids, start, match, span = index.hits(np.frombuffer(b"".join(data), np.uint8), off)
        want = [(i, 7, 1, n - m, n) for i, (m, _) in enumerate(texts) if m <= n // 5]
        assert list(zip(*(x.tolist() for x in (doc, ids, start, match, span)), strict=True)) == want


def test_toxicity_uses_all_terms(spark):
    # 20 labelled rows, so no chi-square reaches 30; the telling words are in two rows each
    calm = [(i, f"calm day tree sun w{i}", 0) for i in range(10)]
    foul = [(10 + i, f"calm day tree sun vile{i // 2} w{i}", 1) for i in range(10)]
    asked = [(100 + i, f"calm day tree vile{i}") for i in range(5)] + [(200, "calm day tree sun w3"), (300, "unknown"), (400, None)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in calm + foul] + asked, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in calm + foul], "doc_id long, toxic int")
    model = toxicity.fit(spark, texts, labels)
    assert len(model.terms) == len({w for _, t, _ in calm + foul for w in t.split()}) and model.idf.min() > 0
    got = by_id(toxicity.score(spark, texts, model))
    assert all(int(got[100 + i]["evidence"].split(":")[0]) in (10 + 2 * i, 11 + 2 * i) for i in range(5))
    assert got[300]["score"] == got[400]["score"] == model.blank and got[300]["evidence"] == ""
    assert len({got[i]["score"] for i in (100, 200)}) == 2


def test_licenses(spark, docs, empty):
    mit = dict(licenses.KNOWN)["ISC"]
    extra = spark.createDataFrame(
        [(1000, "Copyright (c) 2020 A\n" + mit.upper().replace(",", " ,")), (1001, "intro\nlicenced under CC BY-NC 4.0"), (1002, "Copyright 1999 B")],
        "doc_id long, text string",
    )
    got = by_id(licenses.license_scan(spark, extra))
    assert got[1000]["license_id"] == "ISC" and got[1001]["notices"] == "CC-BY-NC-4.0" and not got[1002]["matched"]
    assert sum(r["license_id"] == "Apache-2.0" for r in licenses.license_scan(spark, docs).collect()) == 1
    assert licenses.license_scan(spark, empty).count() == 0


@pytest.mark.parametrize("most", [10_000, 0])
def test_licenses_joined(spark, monkeypatch, most):
    # repeated rows, very long texts, several notices, and a known table that is joined without a broadcast
    monkeypatch.setattr(licenses, "MAX_KNOWN", most)
    notes = "Released under the MIT License.\nplain\nLicensed under CC BY 4.0.\nReleased under the MIT license\n"
    rows = [(1, notes * 3000), (1, notes * 3000), (2, None), (2, ""), (3, "a licence of no kind\n" * 5000), (4, "x" * 300_000)]
    got = [tuple(r) for r in licenses.license_scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "license_id", "notices", "matched").collect()]
    assert sorted(got, key=str) == [(1, None, "CC-BY-4.0,MIT", True)] * 2 + [(2, None, "", False)] * 2 + [(3, None, "", False), (4, None, "", False)]


def test_license_digests(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(i, (folder / f).read_text(encoding="utf-8"), n) for i, (f, n) in enumerate(names.items()) if (folder / f).exists()]
    if not texts:
        pytest.skip("no licence texts on this machine")
    # other spacing, case and quotes change nothing; a missing word does
    odd = [(100 + i, t.upper().replace("\n", "\n\n  "), n) for i, t, n in texts] + [(200 + i, t.replace(" the ", " ", 1), None) for i, t, _ in texts]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts + odd], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in licenses.license_scan(spark, docs).collect()} == {i: n for i, _, n in texts + odd}


def test_urls(spark):
    cases = [
        (1, "http://A.Example.com/en/1", "a.example.com", "/en/1", "com/en/", "block"),
        (2, "https://example.com/en/77?x", "example.com", "/en/77", "example.com/en/7", "allow"),
        (3, "http://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
        (4, "http://www.example.net/de/81#a", "www.example.net", "/de/81", "example.net/de/8", "block"),
        (5, None, "", "", None, None),
        (6, "no scheme", "", "", None, None),
        (7, "ftp://xcom/en/1", "xcom", "/en/1", None, None),
        (8, "http://org/es/", "org", "/es/", "org/es/", "block"),
    ]
    pages = spark.createDataFrame([(c[0], c[1], "h", "r") for c in cases], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in urls.url_filter(spark, pages).collect()}
    for i, _, host, path, rule, verdict in cases:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict or verdict is None and got[i]["verdict"] in ("allow", "block")
    assert got[5]["verdict"] == got[6]["verdict"]


def test_url_model_equals_plain_descent(spark):
    import math

    weights = urls.fit(spark)

    def grams(s):
        s = f"^{s}$"
        return [int(hashlib.md5(s[i : i + 3].encode()).hexdigest()[:6], 16) % urls.DIMENSIONS for i in range(max(len(s) - 2, 1))]

    rows = []
    for url, y in sorted(urls.LABELLED):
        g = grams(url.split("://", 1)[1])
        x = [0.0] * urls.DIMENSIONS + [1.0]
        for f in g:
            x[f] += 1
        rows.append((y, [v / math.sqrt(len(g)) for v in x[:-1]] + [1.0]))
    w = [0.0] * (urls.DIMENSIONS + 1)
    for _ in range(urls.EPOCHS):
        for y, x in rows:
            step = urls.RATE * (y - 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))))
            w = [a * (1 - urls.RATE * urls.DECAY) + step * b for a, b in zip(w, x, strict=True)]
    assert np.allclose(w, weights, atol=1e-9)


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    out = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    bench = " ".join("nothing%d" % i for i in range(20))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS, name
    got = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert got == docs.count() and 0 < got < len(rows)
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0


def test_pipeline_rows_of_their_own(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    say = lambda n: " ".join("w%d" % rng.randrange(900) for _ in range(n))
    a, b, item = say(60), say(50), " ".join(f"q{i}" for i in range(15))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def after(stage, rows):
        docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return sorted(((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in stage(spark, docs, str(tmp_path)).collect()))

    tell = lambda *rows: sorted((i or 0, t, len(t)) for i, t in rows)
    # texts of one doc_id are cut each by itself, and a replacement character that the text has stays
    got = after(corpus_pipeline.suffix_dedup, [(1, a), (3, "\ufffdx " + a + " end"), (3, "short"), (None, "y " + a)])
    texts = {(i, t) for i, t, _ in got}
    assert (1, a) in texts and (3, "short") in texts and all(n == len(t) for _, t, n in got)
    assert [t for i, t in texts if i == 3 and t.startswith("\ufffdx") and a not in t] and [t for i, t in texts if i == 0 and a not in t]
    # a clean row stays beside one with a passage of the benchmark, and a null doc_id doesn't save one
    got = after(corpus_pipeline.decontaminate, [(1, a), (1, a + " " + item), (None, item + " " + b), (None, b)])
    assert got == tell((1, a), (None, b))
    got = after(corpus_pipeline.near_dedup, [(1, a), (2, a), (2, b), (5, b), (None, b)])
    assert got == tell((1, a), (2, b))
    # a row that the quality rules reject, by null doc_id and beside a good one
    got = after(corpus_pipeline.quality, [(1, a), (1, "### ###"), (2, b), (3, a + b), (None, "### ###")])
    assert got == tell((1, a), (2, b), (3, a + b))


def test_pipeline_shingles_of_five(spark, tmp_path):
    import corpus_pipeline

    # one word of 43 differs: 36 of 44 sets of four words agree, 34 of 44 of five
    words = [f"w{i}" for i in range(43)]
    a, b = " ".join(words), " ".join([*words[:20], "other", *words[21:]])
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in ((1, a), (2, b))], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["kept"] for r in minhash.near_duplicates(spark, docs).orderBy("doc_id").collect()] == [True, False]
    assert [r["kept"] for r in minhash.near_duplicates(spark, docs, 5).orderBy("doc_id").collect()] == [True, True]
    assert corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).count() == 2


def test_whole_characters(spark):
    import corpus_pipeline

    raw = ["a�b".encode(), "é".encode()[:1] + b"x", b"x" + "日".encode()[:2], "日".encode()[1:] + "�".encode(), b"\x01b \x01a\x01", "�".encode()[:2] + "�\x01".encode(), b"", None]
    docs = spark.createDataFrame([(i, b) for i, b in enumerate(raw)], "i long, b binary").orderBy("i")
    got = [r[0] for r in docs.select(corpus_pipeline.whole_characters(F.col("b"))).collect()]
    assert got == [None if b is None else b.decode("utf-8", "ignore") for b in raw]
