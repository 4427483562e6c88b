"""Whitening, window removal and filter audit against brute force, and their edge cases."""

import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from visloom.llm import filter_audit, whitening, window_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# whitening


def by_definition(vectors, components):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    z = x - s / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return deviation, (z @ axes) / np.sqrt(values), values / np.trace(z.T @ z / n)


def test_whitening_by_definition(spark):
    rng = np.random.default_rng(7)
    data = (rng.normal(size=(300, 12)) * np.geomspace(3, 0.02, 12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    data = data.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), 8).toPandas()
    deviation, white, share = by_definition(data, 8)
    assert len(got) == 300 * 8 and set(got.n) == {300} and got.identity_error.max() < 1e-10
    for k, own in got.groupby("component"):
        own = own.sort_values("vec_id")
        assert [int(v) for v in own.deviation] == deviation
        sign = np.sign((own.whitened * white[:, k - 1]).sum())
        assert np.abs(sign * own.whitened.to_numpy() - white[:, k - 1]).max() < 1e-6
        assert np.allclose(own.explained, share[k - 1], rtol=1e-9)


def test_cholesky_and_rotations():
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (7, 7), (16, 5)):
        half = rng.normal(size=(rank, d)) * np.geomspace(1, 1e-4, rank)[:, None]
        a = half.T @ half
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, a)
        turned = whitening.one_sided_jacobi(factor)
        gram = turned.T @ turned
        assert np.abs(gram - np.diag(gram.diagonal())).max() <= 1e-13 * gram.max()
        assert np.allclose(np.sort(gram.diagonal()), np.sort(np.linalg.svd(half)[1] ** 2), rtol=1e-7)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<float>, n long, whitened string, `a.b` int"
    none = whitening.whitened(spark.createDataFrame([], kind))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = [(1, [1.0, 2.0], 1, "x", 1)]
    assert whitening.whitened(spark.createDataFrame(one * 3, kind)).count() == 0  # no variance
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, None), (7, [1.0]), (8, []), (9, [-3.0, 0.25])]
    got = whitening.whitened(spark.createDataFrame([(*r, 1, "x", 1) for r in rows], kind)).toPandas()
    assert len(got) == 4 * 2 and set(got.n) == {4} and got.vec_id.isna().sum() == 2 and (got.vec_id == 1).sum() == 4
    big = whitening.whitened(spark.createDataFrame([(i, [3e38 * (-1) ** i, float(i)]) for i in range(6)], "vec_id long, embedding array<float>"))
    assert big.where("component = 1").count() == 6 and big.where("identity_error > 0.0001").isEmpty()


def test_deviations_have_no_bound():
    y, rest, n = np.array([[1 << 40, -5], [3, 4]]), np.array([1, 2]), 10**9
    assert whitening._deviations(y, rest, n) == [str(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, rest))) for r in y]


# windows


def kept_by_definition(rows, length):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - length + 1):
            if d is not None:
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def corpus(seed, passages=3):
    """Texts that share passages, copies and long repetitions, over two vocabularies."""
    rng = np.random.default_rng(seed)
    small, large = list("abc"), [f"w{i}é" for i in range(400)]
    shared = [[large[i] for i in rng.integers(0, 400, 25)] for _ in range(passages)]
    rows = []
    for d in rng.permutation(60).tolist():
        w = []
        for _ in range(int(rng.integers(0, 6))):
            kind = rng.integers(0, 4)
            w += [small[i] for i in rng.integers(0, 3, 15)] if kind == 0 else shared[rng.integers(0, passages)] if kind == 1 else ["z"] * 30 if kind == 2 else [large[i] for i in rng.integers(0, 400, 20)]
        rows.append((d, "".join(x + rng.choice([" ", "\n\t", "  "]) for x in w)))
    return rows + [(100 + d, t) for d, t in rows[:10]]


EDGES = [(1, None), (2, ""), (3, " \n"), (None, "a b c a b c a b c a b c"), (4, "a b c a b c a b c a b c"), (5, "A b c a b c a b c a b c"), (5, "a b c a b c a b c a b c"), (5, "a b c a b c a b c a b c"), (6, "  a b c a b c"), (7, "x" * 5000 + " " + "y" * 9000 + " b c d e f"), (8, "q " + "x" * 5000 + " " + "y" * 9000 + " b c d e f")]


@pytest.mark.parametrize("bucket", [window_dedup.BUCKET, 0])
@pytest.mark.parametrize("length", [4, 20])
def test_windows_by_definition(spark, monkeypatch, bucket, length):
    """With the bound at 0 every bucket goes window by window."""
    monkeypatch.setattr(window_dedup, "BUCKET", bucket)
    for rows in (corpus(length), EDGES, corpus(3) * 2):
        docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, th int, p string, `g.x` double").repartition(3)
        got = window_dedup.without_repeats(docs, length, gram=3).collect()
        assert sorted((tuple(r) for r in got), key=str) == kept_by_definition(rows, length)


def test_windows_in_small_pieces(spark, monkeypatch):
    """Cuts of super-k-mers, segments and chunks change nothing."""
    rows = [r for r in corpus(9)]
    want = kept_by_definition(rows, 6)
    monkeypatch.setattr(window_dedup, "CUT", 2)
    keyed = window_dedup._keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").toArrow()
    full = list(window_dedup._pieces(keyed.column("text").combine_chunks(), 6))
    monkeypatch.setattr(window_dedup, "WORDS", 7)
    parts = list(window_dedup._pieces(keyed.column("text").combine_chunks(), 6))
    starts = lambda pieces: sorted({(int(t), int(p)) for f, b, e, text, place in pieces for t, p in zip(text[: max(len(b) - 5, 0)], place) if True})
    assert set(starts(full)) <= set(starts(parts)) and max(len(b) for _, b, *_ in parts) == 12
    assert sorted((tuple(r) for r in window_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 6, 3).collect()), key=str) == want


def test_buckets_over_several_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = corpus(21, passages=1)
        got = window_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 10, 3).collect()
        assert sorted((tuple(r) for r in got), key=str) == kept_by_definition(rows, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_window_ranks():
    rng = np.random.default_rng(5)
    words = [b"ab"[i : i + 1] * (1 + int(j)) for i, j in zip(rng.integers(0, 2, 500), rng.integers(0, 2, 500))]
    flat = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])[:-1]])
    for length in (1, 2, 3, 7, 50):
        rank = window_dedup.window_ranks(flat, begin, length)
        seen = {}
        for i in range(len(words) - length + 1):
            assert seen.setdefault(tuple(words[i : i + length]), rank[i]) == rank[i]
        assert len(set(seen.values())) == len(seen)


def test_windows_of_nothing(spark):
    got = window_dedup.without_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and got.columns == ["doc_id", "n_words", "n_removed", "kept"]


# filters


def measures_by_definition(t):
    w = WORD.findall(t)
    return [len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall("[#$%&*|]", t))]


TEXTS = ["", " ", "a", "A A a", "Ünï çödé 日本語 日本語 \U0001f600", " x y", "# $%&*| |", "w\x0bw\x0cw\x1cw", "x" * 7 + " " + "x" * 8 + " " + "x" * 9 + " " + "x" * 17 + " " + "x" * 17 + " " + "x" * 16 + "y", "a b " * 3000, "é" * 100_001]


def test_transducer_by_definition():
    blob = [t.encode() for t in TEXTS]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blob])])
    got = filter_audit.transduced(np.frombuffer(b"".join(blob), np.uint8), offsets)
    assert got.tolist() == [measures_by_definition(t) for t in TEXTS]


def test_table_verifies_bytes():
    """With one hash for all words, the bytes alone tell them apart."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("ab"), rng.integers(1, 30))) for _ in range(300)] + ["same" * 9] * 5
    flat = np.frombuffer("".join(w + " " for w in words).encode(), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    begin = end - [len(w) for w in words]
    text = np.arange(len(words)) % 2
    spans = filter_audit.Spans(flat, begin, end, text)
    for h in (None, np.zeros(len(words), np.uint64), spans.hashes() & np.uint64(3)):
        assert spans.first_seen(h).sum() == len(set(zip(words, text.tolist())))


def audit_by_definition(docs, labels):
    good, toxic = ({r[0] for r in labels if r[k] == 1} - {None} for k in (1, 2))
    out = []
    failed = []
    for d, t, lang in docs:
        w, t = WORD.findall(t or ""), t or ""
        caps = len(re.findall("[A-Z]", t))
        copy = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * caps > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        failed.append((d, lang or "", {k for k, v in fails.items() if v}))
    for part in {p for _, p, _ in failed}:
        own = [(d, f) for d, p, f in failed if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, x in enumerate(order):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                shapley[x] += len(gone)
                rows.append([part, order, step + 1, len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)])
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_audit_by_definition(spark):
    rng = np.random.default_rng(4)
    long = " ".join(f"w{i}" for i in range(250))
    pool = [*TEXTS, None, long, long + " #", long + " " + "CAPS " * 60, "dull " * 300, long.upper()]
    docs = [(int(d), pool[rng.integers(len(pool))], ["de", "en", None, ""][rng.integers(4)]) for d in rng.permutation(80)]
    docs += [docs[0], (None, long, "en"), (None, None, None)]
    labels = [(int(d), int(rng.integers(2)), int(rng.integers(2))) for d in rng.integers(0, 90, 60)] + [(1, None, None), (None, 1, 1)]
    table = spark.createDataFrame([(*r, 3, "x", 1) for r in docs], "doc_id long, text string, lang string, mask int, sha string, `n.words` int").repartition(3)
    got = filter_audit.audit(filter_audit.failures(table), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.select(names).collect()) == audit_by_definition(docs, labels)


def test_audit_of_nothing(spark):
    none = filter_audit.failures(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    one = filter_audit.failures(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"))
    got = filter_audit.audit(one, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.count() == 600 and got.where("part = ''").count() == 600 and got.agg(F.sum("removed")).first()[0] == 120
