"""Language identification, quality and the class n-grams: held-out figures, definitions and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemrec.llm import class_lm, langid, quality
from itemrec.llm.common import id_bucket

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_id_bucket(spark):
    df = spark.createDataFrame([(1,), (-7,), (None,), (123456,)], "i bigint")
    assert [r[0] for r in df.select(id_bucket(F.col("i"), 5)).collect()] == [zlib.crc32(x) % 5 for x in (b"1", b"-7", b"", b"123456")]


def by_definition_nb(rows, buckets):
    """Predictions of a multinomial naive Bayes model in plain Python: {id: (lang, probability)}."""
    import math
    from collections import Counter

    def grams(text):
        points = [ord(c) for c in f" {text.lower()} "]
        for i in range(len(points)):
            key = 0
            for n in range(1, 4):
                if i + n <= len(points):
                    key = (key * 31_337 + points[i + n - 1] + n) * 2_654_435_761 % 2**32
                    yield (key >> 7) % buckets

    counts, documents = {}, Counter()
    for i, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 5:
            documents[lang] += 1
            counts.setdefault(lang, Counter())
            if any(c.isalpha() for c in text):
                counts[lang].update(grams(text))
    out = {}
    for i, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            out[i] = ("und", 0.0)
            continue
        times = Counter(grams(text))
        score = {}
        for lang in sorted(documents):
            total = sum(counts[lang].values()) + 0.5 * buckets
            score[lang] = math.log(documents[lang] / sum(documents.values())) + sum(n * math.log((counts[lang][g] + 0.5) / total) for g, n in times.items())
        best = max(score, key=score.get)
        out[i] = (best, 1 / sum(math.exp(s - score[best]) for s in score.values()))
    return out


def test_naive_bayes_equals_its_definition(spark, docs):
    rows = [(r.doc_id, (r.text or "")[:1_500] if r.doc_id % 9 else r.text, r.lang) for r in docs.where("doc_id < 90").collect()]
    rows += [(1_001, None, "en"), (1_002, "123 !", "en"), (1_003, "", None), (1_004, "Et", None), (1_005, "ß Ä", "xx"), (1_006, "\U0001f600 a", "xx")]
    rows = [(i, t and t[:3_000], x) for i, t, x in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df, learn=id_bucket(F.col("doc_id"), 5) != 0)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model, "text", "doc_id").collect()}
    want = by_definition_nb(rows, langid.BUCKETS)
    assert found.keys() == want.keys()
    assert all(found[i][0] == want[i][0] and abs(found[i][1] - want[i][1]) < 1e-6 for i in want)


def test_language_of_held_out_documents(docs):
    held = id_bucket(F.col("doc_id"), 5) == 0
    found = langid.predict(docs, langid.fit(docs, learn=~held), "text", "doc_id", "lang").where(held).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_many_languages_are_scored_in_slices_of_the_same_features(docs, monkeypatch):
    def predicted():
        return {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs), "text", "doc_id").collect()}

    whole = predicted()
    monkeypatch.setattr(langid, "MATRIX_BYTES", 3 * 8 * langid.BUCKETS)
    sliced = predicted()
    assert {i: x[0] for i, x in sliced.items()} == {i: x[0] for i, x in whole.items()}
    assert np.allclose([sliced[i][1] for i in whole], [x[1] for x in whole.values()], atol=1e-9)


def test_grams_are_the_same_in_blocks(monkeypatch):
    text = "Ein Überblick über die Blöcke 🙂 " * 5
    whole = langid.counts(text, 512)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (langid.counts(text, 512) == whole).all()
    assert whole.sum() == 3 * (len(text) + 2) - 3


def test_language_odd_rows(spark):
    rows = [(1, "hello there friend", "en"), (1, "hello there friend", "en"), (2, "guten tag freund", "de"), (3, None, "en"), (4, "123 !", "fr"), (None, "tag", None), (5, "", "de"), (6, "hello " * 300_000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, lang_pred string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, langid.fit(df), "text", "doc_id").collect()}
    assert found[3] == found[4] == found[5] == ("und", 0.0)
    assert (found[1][0], found[2][0], found[None][0], found[6][0]) == ("en", "de", "de", "en")
    nothing = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, nothing, "text", "doc_id").collect()} == {"und"}
    assert langid.predict(df.limit(0), nothing, "text", "doc_id").collect() == []


def auc(labels, scores):
    order = np.argsort(scores)
    ranks = np.empty(len(order))
    ranks[order] = np.arange(len(order))
    labels = np.array(labels)
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    return (ranks[labels == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_quality_of_held_out_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = id_bucket(F.col("doc_id"), 4) == 2
    model = quality.fit(docs, labels, ~held)
    found = quality.predict(docs.join(labels, "doc_id").where(held), model, "text", "quality").collect()
    y, s = [r.quality for r in found], np.array([r.score for r in found])
    assert auc(y, s) > 0.9
    assert np.mean((s >= 0.7) == np.array(y)) > 0.9


def test_quality_votes_are_those_of_the_nearest(docs, spark):
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), sample_each=40)
    assert len(model.labels) <= 80
    texts = [(r.text or "").encode() for r in docs.limit(5).collect()]
    vectors = model.project(texts)
    for v, s in zip(vectors, model.score(texts), strict=True):
        near = sorted(range(len(model.labels)), key=lambda i: -float(v @ model.vectors[i]))[: quality.NEIGHBOURS]
        weight = [np.exp(quality.STEEPNESS * float(v @ model.vectors[i])) * model.say[i] for i in near]
        assert s == pytest.approx(sum(w for w, i in zip(weight, near, strict=True) if model.labels[i] == 1) / sum(weight), rel=1e-4)


def test_quality_odd_rows(spark):
    rows = [(1, "a good text of words"), (1, "a good text of words"), (2, "BAD!! BAD!!"), (3, None), (None, ""), (4, "x " * 200_000)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (9, 1), (None, 0), (3, None)], "doc_id bigint, quality int")
    found = quality.predict(df, quality.fit(df, labels), "text", "doc_id").collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in quality.predict(df, quality.fit(df, labels.limit(0)), "text", "doc_id").collect()} == {0.5}
    assert quality.predict(df.limit(0), quality.fit(df, labels), "text", "doc_id").collect() == []


def base_by_definition(rows, learned):
    def tokens(text):
        return (text or "").encode().lower().split() + [None]

    counts = {}
    for _, t in learned:
        for w in tokens(t):
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    low = total + 0.5 * (len(counts) + 1)
    return total, [(i, len(tokens(t)), sum(w in counts for w in tokens(t)), sum(np.log10((counts.get(w, 0) + 0.5) / low) for w in tokens(t))) for i, t in rows]


def check_lm(rows, df, learn, **options):
    model, cold = class_lm.fit(df, learn, **options)
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in class_lm.score(df, model, cold).collect()), key=lambda r: (str(r[0]), r[3]))
    total, base = base_by_definition(rows, [r for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 != 1])
    assert model.n_tokens == total
    base.sort(key=lambda r: (str(r[0]), r[3]))
    assert [x[:3] for x in found] == [x[:3] for x in base]
    assert np.allclose([x[3] for x in found], [x[3] for x in base])
    return model, found


def learn():
    return id_bucket(F.col("doc_id"), 5) != 1


@pytest.mark.parametrize("options", [{}, {"shared_words": 60, "core_words": 20, "rounds": 3, "hot_words": 10}])
def test_class_model(docs, options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    model, found = check_lm(rows, docs, learn(), **options)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    held = [x for x in found if zlib.crc32(str(x[0]).encode()) % 5 == 1]
    if not options:
        assert sum(x[4] for x in held) > sum(x[3] for x in held), (sum(x[4] for x in held), sum(x[3] for x in held))
    else:
        # All words scored in tasks give the same as most of them looked up by the join.
        whole, cold = class_lm.fit(docs, learn(), shared_words=60, core_words=20, rounds=3)
        assert cold.count() > 1_000
        assert all(np.isfinite(x[4]) for x in found)


def test_joined_words_score_like_shared_ones(spark, docs):
    small = docs.where("doc_id < 150")
    model, cold = class_lm.fit(small, learn(), shared_words=80, core_words=40, rounds=2)
    every = {r.key: (r.n, r["class"]) for r in cold.collect()}
    keys = np.array([*every], np.int64)
    shared_keys = model.lookup.slots[model.lookup.place >= 0]
    at = model.lookup(shared_keys)
    full = np.concatenate([shared_keys, keys])
    whole = class_lm.Model(
        model.n_tokens, model.n_words, model.n_ends, 0, class_lm.Lookup(full), np.concatenate([model.counts[at], [n for n, _ in every.values()]]),
        np.concatenate([model.classes[at], [c for _, c in every.values()]]), np.zeros(class_lm.CLASSES + 1), np.zeros((class_lm.CLASSES + 1,) * 2),
    )
    whole.transition, whole.mass, whole.unseen = model.transition, model.mass, model.unseen
    a = {r.doc_id: r.score for r in class_lm.score(small, model, cold).collect()}
    b = {r.doc_id: r.score for r in class_lm.score(small, whole, cold.limit(0)).collect()}
    assert a.keys() == b.keys() and np.allclose([a[i] for i in a], [b[i] for i in a])


@pytest.mark.parametrize("options", [{}, {"shared_words": 80, "core_words": 40, "rounds": 2}, {"shared_words": 80, "core_words": 20, "rounds": 2, "hot_words": 7}])
def test_scores_are_sums_of_probabilities(docs, options):
    """Each score by its definition; after every class all words and the unseen ones add up to one."""
    small, n = docs.where("doc_id < 200"), class_lm.CLASSES
    model, cold = class_lm.fit(small, learn(), **options)
    slots = model.lookup.place >= 0
    words = {int(k): (int(model.counts[p]), int(model.classes[p])) for k, p in zip(model.lookup.slots[slots], model.lookup.place[slots])}
    words |= {r.key: (r.n, r["class"]) for r in cold.collect()} | {class_lm.END: (model.n_ends, n)}
    assert len(words) == model.n_words
    emission = {k: np.log10(c + 0.5) - model.mass[of] for k, (c, of) in words.items()}
    for before in range(n + 2):
        known = sum(10 ** (model.transition[before, of] + emission[k]) for k, (_, of) in words.items())
        assert abs(known + 10 ** model.transition[before, model.unknown] - 1) < 1e-9
    found = {r.doc_id: r.score for r in class_lm.score(small, model, cold).collect()}
    for r in small.collect():
        before, total = n, 0.0
        for k in class_lm.with_ends([(r.text or "").encode()])[0].tolist():
            of = words[k][1] if k in words else model.unknown
            step = model.transition[before, of] + emission.get(k, -model.unseen)
            total, before = total + step, of
        assert abs(total - found[r.doc_id]) < 1e-6 * max(1, abs(total))


@pytest.mark.parametrize("options", [{}, {"shared_words": 80, "core_words": 40, "rounds": 2}, {"shared_words": 80, "core_words": 20, "rounds": 2, "hot_words": 7}])
def test_class_bigrams_are_of_all_tokens(docs, options):
    small, n = docs.where("doc_id < 150"), class_lm.CLASSES
    model, cold = class_lm.fit(small, learn(), **options)
    texts = [(r.text or "").encode() for r in small.where(learn()).select("text").collect()]
    numbers, stops = class_lm.with_ends(texts)
    place, outside = model.lookup(numbers), {r.key: r["class"] for r in cold.collect()}
    of = np.array([n if x == class_lm.END else model.classes[p] if p >= 0 else outside[x] for x, p in zip(numbers.tolist(), place, strict=True)])
    pairs, before = np.zeros((n + 1, n + 1)), np.concatenate([[n], of[:-1]])
    np.add.at(pairs, (before, of), 1)
    held = {x: i for i, x in enumerate(dict.fromkeys(numbers.tolist()))}
    masses = np.bincount(of, minlength=n + 1) + 0.5 * np.bincount([c for _, c in {*zip(numbers.tolist(), of.tolist(), strict=True)}], minlength=n + 1)
    assert len(held) == model.n_words and pairs.sum() == model.n_tokens
    share = masses / masses.sum()
    known = (pairs + class_lm.STRENGTH * share) / (pairs.sum(axis=1, keepdims=True) + class_lm.STRENGTH)
    found = 10 ** model.transition[: n + 1, : n + 1]
    assert np.allclose(found / found.sum(axis=1, keepdims=True), known)


def test_best_classes_are_those_of_best_class():
    random = np.random.default_rng(5)
    n_words, n = 60, class_lm.CLASSES
    big = random.poisson(2.0, (n_words, n_words)) * (random.random((n_words, n_words)) < 0.2)
    of = random.integers(0, n, n_words)
    of[-1] = n
    g = np.zeros((n + 1, n + 1))
    np.add.at(g, (of[:, None], of[None, :]), big)
    right, left = (np.stack([np.bincount(of, x, n + 1) for x in y[:-1]]) for y in (big, big.T))
    found = class_lm.best_classes(right, left, of[:-1], big.diagonal()[:-1], g)
    assert found.tolist() == [class_lm.best_class(*x, g) for x in zip(right, left, of, big.diagonal(), strict=False)]


def test_best_class_is_that_of_the_greatest_likelihood():
    random = np.random.default_rng(3)
    n_words, n = 40, class_lm.CLASSES
    big = random.poisson(2.0, (n_words, n_words)) * (random.random((n_words, n_words)) < 0.3)
    of = random.integers(0, n, n_words)
    of[-1] = n

    def likelihood(of):
        g = np.zeros((n + 1, n + 1))
        np.add.at(g, (of[:, None], of[None, :]), big)
        f = class_lm._xlogx
        return f(g).sum() - f(g.sum(axis=1)).sum() - f(g.sum(axis=0)).sum(), g

    for w in range(10):
        _, g = likelihood(of)
        right, left = (np.bincount(of, x, n + 1) for x in (big[w], big[:, w]))
        every = []
        for c in range(n):
            moved = of.copy()
            moved[w] = c
            every.append(likelihood(moved)[0])
        assert every[class_lm.best_class(right, left, of[w], big[w, w], g)] == pytest.approx(max(every))


def test_class_model_odd_rows(spark):
    rows = [(0, "a b a b a"), (0, "a b a b a"), (2, None), (None, ""), (3, "X\tx\ny"), (5, "new words here"), (7, "a " * 100_000), (11, "é É"), (1, "b a z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n int")
    check_lm(rows, df, learn())
    none, cold = class_lm.fit(df, F.lit(False))
    assert {(r.n_known, r.score, r.base_score) for r in class_lm.score(df, none, cold).collect()} == {(0, 0.0, 0.0)}
    assert class_lm.score(df.limit(0), none, cold).collect() == []


def test_hot_words_only_say_where_lists_are_kept(docs):
    """Classes and bigrams don't depend on which words' neighbours are added up in tasks."""
    small = docs.where("doc_id < 60")
    found = [class_lm.fit(small, learn(), shared_words=300, core_words=50, rounds=2, hot_words=h) for h in (0, 9, 300)]
    for model, cold in found[1:]:
        assert (model.classes == found[0][0].classes).all() and np.allclose(model.transition, found[0][0].transition)
        assert sorted(map(tuple, cold.collect())) == sorted(map(tuple, found[0][1].collect()))


def test_words_without_class_move_to_the_likeliest():
    random = np.random.default_rng(4)
    n_words, n, f = 40, class_lm.CLASSES, class_lm._xlogx
    big = random.poisson(3.0, (n_words, n_words)) * (random.random((n_words, n_words)) < 0.3)
    of = random.integers(0, n, n_words)
    of[-1] = n

    def table(of, big):
        g = np.zeros((n + 1, n + 1))
        np.add.at(g, (of[:, None], of[None, :]), big)
        return g

    for w in range(20):
        outside = big.copy()
        outside[w], outside[:, w] = 0, 0
        right, left, twice = np.delete(big[w], w), np.delete(big[:, w], w), big[w, w]
        others = np.delete(of, w)
        got = class_lm.best_classes(np.bincount(others, right, n + 1)[None], np.bincount(others, left, n + 1)[None], np.array([-1]), np.array([twice]), table(of, outside))[0]
        every = []
        for c in range(n):
            g = table(np.where(np.arange(n_words) == w, c, of), big)
            every.append(f(g).sum() - f(g.sum(axis=1)).sum() - f(g.sum(axis=0)).sum())
        assert every[got] == pytest.approx(max(every), rel=1e-12)
