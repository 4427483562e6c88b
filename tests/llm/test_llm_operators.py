"""The ten operators against brute force, round trips and held-out accuracy, with the edge cases of their docstrings."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from visloom.llm import chat, components, decontaminate, exact_dedup, hashed_ngrams, language_id, mixing, near_dup, quality, queries, suffix_dedup, token_counts, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, keys string, rate double"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], DOCS)


def edge_rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, shared = say(120), say(60)
    near = base.split()
    near[50] = "changed"
    rows = [(1, base), (2, base.upper()), (3, " ".join(near)), (4, say(30) + " " + shared + " " + say(20)), (5, shared + "\n" + say(50))]
    rows += [(6, None), (7, ""), (8, " \n\t"), (9, "one two"), (10, "One  two"), (11, "ab " * 400), (12, say(20000)), (1, base), (None, base), (13, say(40))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, edge_rows())


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def test_op1_equals_brute_force(spark, docs, nothing):
    texts = [(t or "").encode() for _, t in edge_rows()]
    seen = collections.Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    want = collections.Counter()
    for (i, _), t in zip(edge_rows(), texts):
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        want[(i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())] += 1
    got = suffix_dedup.without_repeats(docs, 200).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert collections.Counter(map(tuple, got)) == want
    assert suffix_dedup.without_repeats(nothing, 200).count() == 0


def test_op1_cuts_long_documents_into_segments(spark, monkeypatch):
    rng = random.Random(3)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(2))
    rows = frame(spark, [(1, a + b), (2, b[700:1500]), (3, a[2900:] + b[:150])])
    whole = sorted(map(tuple, suffix_dedup.without_repeats(rows).select("doc_id", "n_removed").collect()))
    data, off = np.frombuffer((a + b).encode(), np.uint8), np.array([0, 6000])
    full = suffix_dedup.runs(data, off, 200)
    starts = sorted(p + k for p, n in zip(full[1], full[2]) for k in range(n))
    assert starts == list(range(6000 - 199))
    assert whole == [(1, 800 + 250), (2, 800), (3, 250)]


@pytest.mark.parametrize("unit", ["a", "ab", "abcdefg hij"])
def test_op1_periodic_texts(spark, unit):
    """A long text of one short unit is few rows, and repeats only itself."""
    text = (unit * 1_000_000)[:1_000_000]
    rows = [(1, text), (2, unit * (230 // len(unit))), (3, "x" * 199), (4, "y" * 200), (5, "z" * 201)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.without_repeats(frame(spark, rows)).collect()}
    assert got == {1: 1_000_000, 2: len(rows[1][1]), 3: 0, 4: 0, 5: 201}
    found = suffix_dedup._runs_of(spark.createDataFrame([(1, text)], "rk long, text string"), 200)
    assert found.count() < 2_000 and found.groupBy().agg(F.sum(F.col("n") * F.col("k"))).head()[0] == 1_000_000 - 199


def test_op2_as_of_join(spark):
    rows = [
        (1, "http://Ex.com/a/", 10, "response", {"etag": "x", "content-length": "5", "date": "1"}, "d1"),
        (2, "https://www.ex.com/a?utm_source=q#f", 20, "response", {"etag": "y", "date": "2"}, "d2"),
        (3, "http://ex.com:80/a", 15, "revisit", {"etag": 'W/x', "date": "3", "content-length": "0"}, None),
        (4, "ex.com/a", 20, "revisit", {"etag": "x"}, None),
        (5, "ex.com/a", 21, "revisit", {"etag": "x"}, None),
        (6, "ex.com/b", 99, "revisit", None, None),
        (7, None, 99, "revisit", {}, None),
        (8, "ex.com/a", None, "revisit", {}, None),
        (9, "ex.com/a", 30, "revisit", {"date": "9"}, None),
    ]
    df = spark.createDataFrame(rows, "rec_id long, url string, ts long, kind string, headers map<string,string>, digest string")
    got = {r["rec_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r["outcome"], r["refers_to"]) for k, r in got.items()} == {3: ("resolved", 1), 4: ("resolved", 1), 5: ("mismatch", 2), 6: ("no_response", None), 7: ("no_response", None), 8: ("no_response", None), 9: ("unvalidated", 2)}
    assert got[3]["headers"] == {"etag": "W/x", "date": "3", "content-length": "5"} and got[3]["digest"] == "d1"
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_op2_header_names_hot_urls_and_repeated_records(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(2 * i, "http://hot.org/x", 1000 + i // 3, "response", {"ETag": f"v{i}", "Content-Length": str(i), "etag": "no"}, f"d{i}") for i in range(400)]
    rows += [(2 * i + 1, "hot.org/x", rng.randrange(990, 1200), "revisit", {"eTAG": f"v{rng.randrange(400)}"}, None) for i in range(400)]
    rows += rows[-3:]
    monkeypatch.setattr(warc, "SLICES", 16)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "rec_id long, url string, ts long, kind string, headers map<string,string>, digest string, _slice int, outcome string")
    full = [r for r in rows if r[3] == "response"]
    want = []
    for r in rows:
        if r[3] == "revisit":
            last = max((f for f in full if f[2] < r[2]), key=lambda f: (f[2], f[0]), default=None)
            tag = r[4]["eTAG"]
            want.append((r[0], "no_response" if last is None else "resolved" if last[4]["ETag"] == tag else "mismatch", last and last[0]))
    got = warc.resolve_revisits(df)
    assert sorted((r["rec_id"], r["outcome"], r["refers_to"]) for r in got.collect()) == sorted(want)
    assert got.where("outcome = 'resolved' AND headers['content-length'] IS NULL").count() == 0


def test_op3_learns_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op3_quality_classifier(spark, "/root/testdata/sf0.01")
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.95 and held.score.between(0, 1).all()


def test_op3_equals_the_average_of_vectors(spark, docs):
    """Scores against the definition: softmax of the mean vector of words and character n-grams, one text at a time."""
    rng = np.random.default_rng(4)
    model = quality.Model(rng.normal(size=(1 << quality.BITS, 3)).astype(np.float32), rng.normal(size=(3, 2)), np.array([0.1, -0.2]))
    for text, got in docs.select("text").join(quality.scored(docs.select("text"), model).dropDuplicates(), "text").select("text", "quality_score").collect():
        data = text.encode()
        at, _ = hashed_ngrams.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]), quality.BITS, quality.GRAMS, True, False)
        z = model.table[at].mean(0) @ model.layer + model.bias if len(at) else model.bias
        assert np.isclose(got, np.exp(z[1]) / np.exp(z).sum(), atol=1e-4)


@pytest.mark.parametrize("grams, words, lower", [((3, 4), True, False), ((2, 3), False, True)])
def test_a_text_has_the_features_of_its_own_bytes_in_any_batch(grams, words, lower):
    rng = random.Random(8)
    texts = ["", "a", "ab ab", "", "same same word", "word again", "x " * 12, " ", "é", "last", "", ""]
    texts += [" ".join(rng.choice(["one", "two", "three", ""]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    table = np.random.default_rng(2).normal(size=(1 << 12, 3))

    def features(batch):
        data = [t.encode() for t in batch]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
        return hashed_ngrams.features(np.frombuffer(b"".join(data), np.uint8), offsets, 12, grams, words, lower)

    alone = [hashed_ngrams.means(features([t]), table, 1)[0] for t in texts]
    for k in range(10):
        order = rng.sample(range(len(texts)), len(texts) - k)
        streams = features([texts[i] for i in order])
        assert np.allclose(hashed_ngrams.means(streams, table, len(order)), [alone[i] for i in order], atol=1e-12)
        by_text = [w @ table[b] for b, w in hashed_ngrams.sparse(streams, len(order))]
        assert np.allclose(by_text, [alone[i] for i in order], atol=1e-5)
    bucket, first = features(texts)
    want = [sum(max(0, len(t) + 3 - k) for k in grams) + (2 * len(re.findall(r"[^ ]+", t)) if words else 0) for t in texts]
    assert np.diff([*first, len(bucket)]).tolist() == want
    assert np.array_equal(alone[0] != 0, np.full(3, 2 in grams))


def test_op3_edges(spark, docs, nothing):
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.sample(quality.learning_labels(none, quality.held_out())))
    got = quality.scored(docs.select("doc_id", "text"), model)
    assert got.count() == len(edge_rows()) and got.where("quality_score < 0.99").count() == 0
    assert quality.scored(nothing, model).count() == 0


def folded(steps, p):
    """Rates after these steps: each goes on by a part of the last change, then subtracts and cuts at zero."""
    r = last = np.ones(len(p))
    for b, *s in steps:
        r, last = np.maximum(0, r + b * (r - last) - p @ np.array(s)), r
    return r


def test_op4_meets_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    names, priors, table = mixing.fit_classifier(docs, labels)
    rows = mixing.posteriors(docs, names, priors, table).cache()
    assert rows.count() == docs.count() and rows.where("abs(p0 + p1 + p2 + p3 - 1) > 1e-9").count() == 0
    want = {r["doc_id"]: len(r["text"].split()) for r in docs.collect() if not re.search(r"[\x1c-\x1f\x85\xa0 -　]", r["text"])}
    assert all(want.get(r["doc_id"], r["n_tokens"]) == r["n_tokens"] for r in rows.collect())
    steps, goal, reached = mixing.fit_rates(rows, len(names))
    assert max(abs(a - b) for a, b in zip(goal, reached)) < 2e-3
    x = rows.toPandas()
    p, n = x[[f"p{i}" for i in range(len(names))]].to_numpy(), x.n_tokens.to_numpy()
    r = folded(steps, p)
    assert np.allclose((r * n) @ p / n.sum(), reached) and np.allclose(sorted(r), sorted(rows.select(mixing.rate_after(steps, len(names)).alias("r")).toPandas().r))


def test_op4_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(docs, labels)
    assert got.count() == len(edge_rows()) and got.where("rate <> 1").count() == 0
    some = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert mixing.mixed(docs, some).where("rate < 0 OR rate IS NULL").count() == 0
    assert mixing.mixed(nothing, some).count() == 0


def soft_rows(spark, mean, sharp, seed=3, size=4000):
    """Token counts and four-domain posteriors of about these mean shares."""
    rng = np.random.default_rng(seed)
    home = rng.choice(4, size, p=mean)
    z = np.log(mean) + sharp * np.eye(4)[home] + rng.normal(0, 1, (size, 4))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    n = rng.integers(1, 400, size)
    return spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, p0 double, p1 double, p2 double, p3 double"), n, p


@pytest.mark.parametrize("sharp", [1.5, 3.0])
def test_op4_meets_skewed_targets_with_rates_at_zero(spark, sharp):
    rows, n, p = soft_rows(spark, [0.02, 0.13, 0.75, 0.1], sharp)
    targets = [0.4, 0.3, 0.2, 0.1]
    steps, goal, reached = mixing.fit_rates(rows, 4, targets)
    r = folded(steps, p)
    assert goal == targets and (r == 0).any() and np.allclose(n * r @ p / n.sum(), reached)
    assert np.all(np.abs(np.array(reached) - targets) <= 1e-3 * np.array(targets))


def least_distance(a, b):
    """Norm of a x - b at the nonnegative x of least squares, by active sets."""
    x, on = np.zeros(a.shape[1]), []
    while True:
        slope = a.T @ (b - a @ x)
        slope[on] = -1
        if slope.max() < 1e-10:
            return np.linalg.norm(a @ x - b)
        on.append(int(slope.argmax()))
        while True:
            z = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (z > 0).all():
                break
            k = min((i for i in range(len(on)) if z[i] <= 0), key=lambda i: x[on[i]] / (x[on[i]] - z[i]))
            x[on] += x[on[k]] / (x[on[k]] - z[k]) * (z - x[on])
            x[on.pop(k)] = 0
        x[:] = 0
        x[on] = z


def test_op4_gradient_alone_meets_targets(spark, monkeypatch):
    """Without Newton steps, the fit is accelerated projected gradient to the end."""
    monkeypatch.setattr(mixing, "_newton", None)
    monkeypatch.setattr(mixing, "GRADIENT", 200)
    rows, n, p = soft_rows(spark, [0.02, 0.13, 0.75, 0.1], 3.0, size=1000)
    steps, goal, reached = mixing.fit_rates(rows, 4, [0.4, 0.3, 0.2, 0.1])
    r = folded(steps, p)
    assert 2 < len(steps) < 200 and (r == 0).any() and np.allclose(n * r @ p / n.sum(), reached)
    assert np.all(np.abs(np.array(reached) - goal) <= 1e-3 * np.array(goal))


def test_samples_take_the_smallest_hashes_of_each_label(spark):
    labels = spark.range(9000).selectExpr("id AS doc_id", "int(id % 9 = 0) AS label").unionByName(spark.sql("SELECT 1L AS doc_id, int(null) AS label"))
    for parts in (1, 7):
        got = quality.sample(labels.repartition(parts), max_rows=300).toPandas()
        hashed = labels.selectExpr("doc_id", "label", "xxhash64(doc_id, 'sample') AS h").toPandas()
        for label in (0, 1):
            want = hashed[hashed.label == label].nsmallest(300, "h").doc_id
            assert sorted(got[got.label == label].doc_id) == sorted(want)
        assert len(got) == 600
    assert quality.sample(labels, max_rows=9000).count() == 9000


def test_op4_targets_out_of_reach_get_the_least_distance(spark):
    rows, n, p = soft_rows(spark, [0.02, 0.13, 0.75, 0.1], 0.5, size=300)
    _, goal, reached = mixing.fit_rates(rows, 4, [0.97, 0.01, 0.01, 0.01])
    root = np.linalg.cholesky(np.linalg.inv((p * n[:, None]).T @ p / n.sum()))
    best = least_distance(root.T @ p.T, root.T @ np.array(goal))
    assert 0.01 < best <= np.linalg.norm(root.T @ (np.array(goal) - reached)) <= 1.001 * best
    with pytest.raises(RuntimeError):
        mixing.fit_rates(rows, 4, [0.97, 0.01, 0.01, 0.01], limit=3)


def test_op4_rows_carry_target_and_reached(spark, docs):
    some = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(docs, some).toPandas()
    shares = sum(np.array(p) * e for p, e in zip(got.posterior, got.expected_tokens)) / got.n_tokens.sum()
    assert np.allclose(got.reached[0], shares) and np.allclose(sum(got.target[0]), 1)


def brute_components(rows, rule):
    words = re.compile(rb"[^\x20\x09-\x0D]+")
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = words.findall((t or "").encode().translate(low))
        sets.append({tuple(w[j : j + rule.k]) for j in range(len(w) - rule.k + 1)} if len(w) >= rule.k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and rule.den * both >= rule.num * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(d, len(sets[i]), min([x for x in least[find(i)] if x is not None], default=None)) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("rule", [near_dup.Rule(4, 85, 100), near_dup.Rule(2, 1, 2)])
def test_op5_equals_brute_force(spark, docs, nothing, rule):
    rng = random.Random(9)
    rows = edge_rows()
    for g in range(6):  # groups of near copies, one of them larger than SMALL
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([8, 25, 90]))]
        for c in range(40 if g == 0 else 5):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(900)}"
            rows.append((100 + 50 * g + c, " ".join(w)))
    got = near_dup.near_duplicates(frame(spark, rows), rule)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_components(rows, rule))
    assert near_dup.near_duplicates(nothing, rule).count() == 0


def test_op5_texts_of_one_template_are_not_paired_with_each_other(spark, monkeypatch):
    """Many texts that share most of their words link only where they should, and few pairs are tested."""
    rng, tested, met = random.Random(4), [], []
    whole, meet = near_dup.linked, near_dup._meeting

    def counted(pairs, *a):
        tested.append(pairs.count())
        return whole(pairs, *a)

    def seen(*a):
        met.append(meet(*a))
        return met[-1]

    monkeypatch.setattr(near_dup, "linked", counted)
    monkeypatch.setattr(near_dup, "_meeting", seen)
    monkeypatch.setattr(near_dup, "discard", lambda *a: None)
    rule, rows = near_dup.Rule(4, 85, 100), []
    for g in range(120):
        own = [f"o{rng.randrange(10**6)}" for _ in range(30)]
        words = own[:15] + [f"t{i}" for i in range(70)] + own[15:]
        rows.append((g, " ".join(words)))
        if g % 3 == 0:
            rows.append((1000 + g, " ".join([f"x{g}", *words[1:]])))
    got = near_dup.near_duplicates(frame(spark, rows), rule)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_components(rows, rule))
    assert sum(tested) < 160 * 2 and sum(m.count() for m in met) < 160 * 2


@pytest.mark.parametrize("changes", [9, 3])
def test_op5_large_group_of_near_copies(spark, monkeypatch, changes):
    """Copies of one text with up to ``changes`` words changed, on both sides of the threshold."""
    rng, rule = random.Random(changes), near_dup.Rule(4, 85, 100)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(150)] = f"v{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    got = near_dup.near_duplicates(frame(spark, rows), rule)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_components(rows, rule))


def test_op5_shifted_sets_lose_no_link(spark):
    """Whatever the pivot, linked sets meet among their first elements unless both link with the pivot."""
    rng, rule = random.Random(6), near_dup.Rule(3, 4, 5)
    base = [f"w{i}" for i in range(60)]
    texts = {0: " ".join(base)}
    for i in range(1, 80):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(60)] = f"v{rng.randrange(40)}"
        texts[i] = " ".join(w)
    for i in range(80, 120):  # at all distances from the pivots
        w = [f"u{j}" for j in range(60)] if i % 2 else [*base[: i - 70], *(f"u{j}" for j in range(i - 70, 60))]
        w[rng.randrange(60)] = f"x{i % 5}"
        texts[i] = " ".join(w)
    data = spark.createDataFrame(list(texts.items()), "sid long, text string").cache()
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(58)} for i, t in texts.items()}
    shapes = spark.createDataFrame([(i, [0] * 8) for i in texts], "sid long, sketch array<long>")
    link = lambda a, b: len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4
    for p in (0, 7, 41):
        moved = near_dup.shifted(data.selectExpr(f"{p}L as p", "sid", "sid as root"), data, rule)
        near = moved.where(F.col("p") == p).collect()
        assert len(near) > 60 and all(r["s"] == len(sets[r["sid"]] ^ sets[p]) for r in near)
        assert all(r["s"] == r["n"] == len(sets[r["sid"]]) for r in moved.where(F.col("p") != p).collect())
        met = {(r["a"], r["b"]) for r in near_dup._meeting(near_dup.first_elements(moved, shapes, rule), rule).collect()}
        missed = [(a, b) for b in texts for a in range(b) if sets[a] != sets[b] and link(a, b) and (a, b) not in met]
        assert all(link(a, p) and link(b, p) for a, b in missed)


def test_op5_keeps_one_row_of_each_component(spark):
    say = lambda *w: " ".join(w)
    base = [f"w{i}" for i in range(80)]
    near, other = say("x", *base[1:]), say(*[f"o{i}" for i in range(30)])
    rows = [(1, say(*base)), (1, say(*base)), (2, near), (5, near), (5, other), (None, other + " z"), (3, other + " z"), (7, ""), (None, "tiny"), (None, "tiny")]
    kept = near_dup.keep_first(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", say(*base)), ("3", other + " z"), ("7", ""), ("None", "tiny")])


def test_components_of_long_chains(spark, monkeypatch):
    """Chains far longer than any fixed number of rounds, with vertices in random order, and a star."""
    monkeypatch.setattr(components, "written", _counted := _Counted(components.written))
    rng = random.Random(2)
    names = rng.sample(range(10_000), 1500)
    chains = [names[:1000], names[1000:1300]]
    star = names[1300:]
    links = [p for c in chains for p in zip(c, c[1:])] + [(star[0], x) for x in star[1:]] + [(star[3], star[3])]
    got = {r["v"]: r["root"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: min(c) for c in [*chains, star] for v in c}
    assert _counted.rounds < 3 * 20
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


class _Counted:
    def __init__(self, f):
        self.f, self.rounds = f, 0

    def __call__(self, *a):
        self.rounds += 1
        return self.f(*a)


def test_op6_held_out_accuracy_and_edges(spark, docs, nothing):
    d = "/root/testdata/sf0.01"
    got = queries.op6_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() > 0.97 * got.count()
    langs, table = language_id.fit(docs)  # no language is known
    out = language_id.identified(docs, langs, table)
    assert out.count() == len(edge_rows()) and out.where("lang_pred <> 'und'").count() == 0
    two = spark.createDataFrame([(1, "the cat", "en"), (2, "der hund", "de"), (3, "123", "en"), (4, None, "en")], "doc_id long, text string, lang string")
    langs, table = language_id.fit(two)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identified(two, langs, table).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und"}
    assert language_id.identified(nothing, langs, table).count() == 0


@pytest.mark.parametrize("n", [2, 4, 7, 12])
def test_op6_codewords_differ(n):
    code = language_id.codewords(n)
    assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= max(1, code.shape[1] // 5)


def test_op7_equals_the_library(spark, docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = ["it's we'll they're I'd you've I'm don't", "''s 'r 'rx 've!! 'l 'll a'b '", "x1y22 3.5% ½ ²", "Ünïcödé é ÀÉ ßẞ İ Σας ﬁ", "日本語 テスト が゙", "a<|endoftext|>b <|startoftext|> <|x|>", "'''", "​  tab\tnew\n\n", "😀👍🏽 ok", "a" * 3000, "'", "'r'", "'v 'e", "!'s", "1's"]
    rng = random.Random(1)
    odd += ["".join(rng.choice("ab1 's'trvel!d\n.é") for _ in range(rng.randrange(1200))) for _ in range(60)]
    rows = edge_rows() + [(500 + i, t) for i, t in enumerate(odd)]
    want = collections.Counter((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    assert collections.Counter(map(tuple, token_counts.token_counts(frame(spark, rows), path).collect())) == want
    assert token_counts.token_counts(nothing, path).count() == 0


def test_op7_every_code_point():
    """A short text for every code point, the character in three places, against the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, counter = Tokenizer.from_file(path), token_counts.Counter(path, token_counts.class_tables(path))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not 0x40000 <= c < 0xDF000]
    for i in range(0, len(points), 20_000):
        texts = [f"ab{chr(c)}cd {chr(c)}9 !{chr(c)}" for c in points[i : i + 20_000]]
        want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert counter.count(texts).tolist() == want


def test_op7_merges_of_long_pieces():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, merges, rng = Tokenizer.from_file(path), token_counts.Merges(path), random.Random(3)
    pieces = ["".join(rng.choice("aeiorstnlé") for _ in range(n)) for n in [*range(1, 40), 5000, 60_000]] + ["a" * 9999, "!" * 777, "日本" * 50]
    pieces += ["".join(rng.choice("aeiorstnlé") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["aaaaaaa", "é"]
    want = [len(tok.encode(x, add_special_tokens=False).ids) for x in pieces]
    data = [x.encode() for x in pieces]
    assert [merges.count(x) for x in data] == want
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    assert merges.counts(np.frombuffer(b"".join(data), np.uint8), offsets).tolist() == want


def test_op8_finds_planted_items_and_edges(spark, nothing):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    items = [(i, say(15) + ". " + say(12) + ".") for i in range(30)] + [(90, None), (91, ""), (92, "tiny one"), (0, "again " + say(20))]
    rows = [(1, say(300) + " " + items[3][1].upper() + " " + say(500)), (2, items[5][1]), (3, say(900)), (4, None), (5, ""), (6, "Tiny one"), (7, items[7][1][: len(items[7][1]) // 2] + say(40)), (8, say(3000) + " " + items[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(frame(spark, rows), bench).where("contaminated")
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, 3), (2, 5), (6, 92), (8, 9)]
    kept = decontaminate.clean(frame(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 7] and kept.columns == frame(spark, rows).columns
    assert decontaminate.matches(nothing, bench).count() == 0 and decontaminate.matches(frame(spark, rows), bench.limit(0)).count() == 0


def test_op8_short_items_match_as_contiguous_words(spark):
    """Items of one to six words against a search for their words in a row."""
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(12)}" for _ in range(n))
    items = [(i, say(1 + i % 6)) for i in range(60)]
    texts = [(i, say(n)) for i, n in enumerate([0, 1, 2, 3, 4, 5, 79, 80, 81, 120, 300, 700])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(frame(spark, texts), bench, overlap=1.0).where("contaminated")

    def holds(text, item):
        w, x = text.split(), item.split()
        k = min(5, len(x))
        return all(any(w[a : a + k] == x[s : s + k] for a in range(len(w) - k + 1)) for s in range(len(x) - k + 1))

    want = {(d, i) for d, t in texts for i, x in items if holds(t, x)}
    assert want - {(d, i) for d, i in want if d < 6} and {(r["doc_id"], r["item_id"]) for r in got.collect()} >= {(d, i) for d, i in want if len(items[i][1].split()) < 5}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} <= want
    kept = {r["doc_id"] for r in decontaminate.clean(frame(spark, texts), bench, overlap=1.0).collect()}
    assert not kept & {d for d, i in want if len(items[i][1].split()) < 5}
    named = spark.createDataFrame([(1, "name the capital")], "item_id long, text string")
    found = decontaminate.matches(frame(spark, [(1, "please name the capital of that country now"), (2, "the capital has a name")]), named)
    assert [(r["doc_id"], r["contaminated"]) for r in found.orderBy("doc_id").collect()] == [(1, True), (2, False)]


def test_op8_shards_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(i, say(15) + ". " + say(12) + ".") for i in range(24)] + [(24, say(900)), (3, "same " + say(9)), (3, "same " + say(9))]
    rows = frame(spark, [(i, say(80) + " " + items[i][1] + " " + say(80)) for i in range(25)] + [(50, say(200)), (51, items[24][1][:3000])])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.matches(rows, bench).collect()))
    assert sorted(r[:2] for r in want if r[-1]) == [(i, i) for i in range(25)]
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 900)
    assert sorted(map(tuple, decontaminate.matches(rows, bench).collect())) == want
    assert sorted(r["doc_id"] for r in decontaminate.clean(rows, bench).collect()) == [50, 51]


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.6])
def test_op8_wand_loses_nothing(spark, threshold):
    """Cursors against the scores of every passage and part."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(n))
    items = [(i, say(rng.choice([3, 25, 100]))) for i in range(120)]
    seen = decontaminate.statistics(spark.createDataFrame(items, "item_id long, text string"), "text")
    index = decontaminate.build_index(items, 5, seen)
    sizes = [-(-len(t.split()) // decontaminate.PART) for _, t in items]
    assert seen.parts == sum(sizes) == len(index.item) and np.isclose(seen.mean, sum(len(t.split()) for _, t in items) / seen.parts)
    full = np.zeros((len(index.terms), len(index.item)))
    for t in range(len(index.terms)):
        here = slice(index.first[t], index.first[t + 1])
        full[t, index.part[here]] = index.impact[here]
    assert np.allclose(full.sum(0), 1)
    texts = [say(400) for _ in range(6)] + [items[k][1] for k in range(9)]
    words, doc = decontaminate._hash(texts)
    got = {(int(a), int(b)): c for a, b, c in decontaminate.candidates(words, doc, index, threshold)}
    want = collections.defaultdict(float)
    for d in range(len(texts)):
        own = words[doc == d]
        for s in range(0, len(own), decontaminate.PART):
            t = np.searchsorted(index.terms, own[s : s + 2 * decontaminate.PART])
            t = np.unique([x for x, w in zip(t, own[s : s + 2 * decontaminate.PART]) if x < len(index.terms) and index.terms[x] == w]).astype(int)
            for x in np.flatnonzero(full[t].sum(0) >= threshold):
                at = (d, int(index.item[x]))
                want[at] = max(want[at], full[t].sum(0)[x])
    assert want and got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got)


def test_op9_recovers_roles_of_conversations_it_has_not_learned_from(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op9_chat_format(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/conversations.parquet").select("conv_id").distinct().count()
    held = [r for r in got if r["held_out"]]
    exact = sum(r["roles"] == r["true_roles"] for r in held) / len(held)
    assert len(held) > 100 and exact > 0.9


def chat_model(rng, names=("user", "bot")):
    return chat.smoothed(list(names), *(rng.integers(0, 9, n) * 1.0 for n in (9, (9, 9), (9, len(names) + 2), (9, chat.SHAPES))))


def test_op9_viterbi_equals_the_best_of_all_paths():
    rng = np.random.default_rng(5)
    many = np.array([3, 0, 4, 1, 4, 3, 2])
    for _ in range(6):
        model = chat_model(rng)
        marks, shapes = rng.integers(0, 4, many.sum()), rng.integers(0, chat.SHAPES, many.sum())
        state = chat.viterbi(model, marks, shapes, many)
        at = 0
        for n in many:
            m, s, path = marks[at : at + n], shapes[at : at + n], state[at : at + n]
            at += n

            def score(p):
                return model.start[p[0]] + sum(model.move[i, j] for i, j in zip(p, p[1:])) + sum(model.mark[x, y] + model.shape[x, z] for x, y, z in zip(p, m, s))

            if n:
                assert np.isclose(score(path), max(score(p) for p in itertools.product(range(9), repeat=int(n))))


def test_op9_edges(spark):
    rng, texts = np.random.default_rng(7), pa.array([None, "", "User: hi\nthere\n\nBot: yes\n### Bot\nNote: stop", "x", "\n\n", "User: hi\nthere\n\nBot: yes\n### Bot\nNote: stop"])
    turns, role, said = chat.parse(chat_model(rng), texts)
    assert turns[:2].tolist() == [0, 0] and (turns[2:] > 0).all() and turns[2] == turns[5]
    said = said.to_pylist()
    assert said[: turns[2]] == said[-turns[5] :]
    assert chat.render(turns, pa.array(chat.ROLES).take(pa.array(role)), pa.array(said))[0].as_py() == ""
    long = pa.array(["\n".join(["User: a", "b"] * 15_000)])
    assert sum(t.count("\n") + 1 for t in chat.parse(chat_model(rng), long)[2].to_pylist()) == 30_000
    kind = "conv_id long, turn long, role string, text string, key int, lines string, page int"
    rows = spark.createDataFrame([(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 0, "assistant", ""), *[(2, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(600)]], kind.split(", key")[0])
    rows = rows.selectExpr("*", "1 as key", "'' as lines", "2 as page")
    raw = chat.transcripts_of(rows)
    model = chat.fit(raw)
    got = {r["key"]: r for r in chat.formatted(raw.withColumn("key", F.col("conv_id")), model).collect()}
    assert len(got) == 3 and got[2]["rendered"].count("<|end|>") == got[2]["n_turns"] > 400
    assert chat.formatted(raw.limit(0).withColumn("key", F.col("conv_id")), chat.fit(raw.limit(0))).count() == 0


def test_op9_learns_what_markers_mean(spark):
    """Words that no list knows become markers."""
    talk = [(c, t, ["user", "assistant"][t % 2], ["zork: where is it?", "blip: it is over there\nand further on"][t % 2]) for c in range(30) for t in range(4)]
    raw = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    lines = raw.groupBy("conv_id").agg(F.expr("flatten(transform(sort_array(collect_list(struct(turn, role, text))), x -> transform(split(x.text, '\n'), (y, i) -> struct(x.role as role, i = 0 as first, y as line))))").alias("lines"))
    model = chat.fit(lines)
    assert model.names == ["blip", "zork"]
    turns, role, said = chat.parse(model, pa.array(["blip: yes\nNote: no\nzork: well?"]))
    assert role.tolist() == [2, 1] and said.to_pylist() == ["yes\nNote: no", "well?"]


def test_op10_equals_brute_force(spark, docs, nothing):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = collections.defaultdict(list)
    for i, t in edge_rows():
        groups[(t or "").translate(low)].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, exact_dedup.exact_groups(docs).collect())) == want
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_op10_hash_collisions_are_split(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00"))
    got = exact_dedup.exact_groups(docs).groupBy("text_sha256").count().collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert len(got) == len({(t or "").translate(low) for _, t in edge_rows()})


def test_op10_keeps_one_row_of_each_text(spark):
    rows = [(1, "aa"), (1, "aa"), (2, "bb"), (5, "cc"), (7, "CC"), (5, "dd"), (None, "ee"), (3, "ee"), (None, None), (None, ""), (4, "AA"), (4, "aA")]
    kept = exact_dedup.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    got = sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in kept.collect())
    assert got == sorted([("4", "aa"), ("2", "bb"), ("7", "cc"), ("5", "dd"), ("3", "ee"), ("None", "")])


def test_op6_decoding_by_definition(spark):
    """Every bit's margin, every codeword's loss and the shares of belief, one number at a time."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    langs, table = language_id.fit(docs)
    code = language_id.codewords(len(langs))
    rows = docs.select("doc_id", "text").limit(40).union(spark.createDataFrame([(-1, ""), (-2, None), (-3, "12 34"), (-4, "é"), (-5, "the der el le " * 50)], "doc_id long, text string")).collect()
    got = {r["doc_id"]: r for r in language_id.identified(spark.createDataFrame(rows, "doc_id long, text string"), langs, table, close=0.99).collect()}
    unsure = 0
    for doc_id, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        ((at, w),) = language_id.sparse(language_id._features(raw, np.array([0, len(raw)])), 1)
        margin = [sum(float(x) * float(table[i, b]) for i, x in zip(at, w)) + float(table[-1, b]) for b in range(code.shape[1])]
        loss = [sum(math.log1p(math.exp(-max(-30.0, min(30.0, z * float(c))))) for z, c in zip(margin, word)) for word in code]
        belief = [math.exp(min(loss) - x) for x in loss]
        belief = [x / sum(belief) for x in belief]
        first, second = sorted(belief)[:-3:-1]
        r = got[doc_id]
        if any(ch.isalpha() for ch in text or ""):
            assert r["score"] == pytest.approx(first, abs=1e-4) and (r["lang_pred"] == langs[loss.index(min(loss))] or first - second < 1e-4)
            if abs(first - second - 0.99) > 1e-3:
                assert r["ambiguous"] == (first - second < 0.99)
            unsure += r["ambiguous"]
        else:
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 1.0, False)
    assert 0 < unsure < 40
