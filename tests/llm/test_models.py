import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import language, quality, queries


@pytest.fixture(scope="module")
def sf(sf_dir):
    return "/root/testdata/sf0.01"


def test_held_out_quality(spark, sf):
    got = queries.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert got.score.between(0, 1).all()


def test_held_out_language(spark, sf):
    got = queries.op10_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_quality_of_odd_rows(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "word " * 50_000, 1.0), (3, "word " * 50_000, 1.0), (None, "x !! !!", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1, 9), (3, 0, 9), (1, None, 9), (None, 1, 9)], "doc_id long, quality int, score int")
    weights = quality.fit(docs, labels, F.lit(True))
    got = quality.score(docs, weights).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.fit(docs, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.keep_good(docs, None, 0.3).columns == docs.columns and quality.keep_good(docs, None, 0.6).count() == 0


def test_ftrl_learns_a_sparse_rule():
    model = quality.Ftrl()
    r = np.random.default_rng(7)
    for _ in range(2000):
        slots = np.unique(r.integers(0, 50, 8))
        model.learn(slots, np.full(len(slots), 1 / np.sqrt(len(slots))), int(3 in slots))
    w = model.weights()
    assert w[3] == w[:50].max() and w[3] > 1
    assert (w[50:-1] == 0).all()


def slots_of(text):
    """A text's features by whole numbers, one at a time."""
    import re
    from collections import Counter

    import xxhash

    def shape(w):
        if not (w[0].isalnum() or w[0] == "_"):
            return 8 + xxhash.xxh32_intdigest(w[:4]) % 240
        return 1 if w.islower() else (2 if len(w) == 1 else 3) if w.isupper() else 4 if w.isdigit() else 5 if w[0].isupper() and w[1:].islower() else 6

    a, b, c, wrap, shift = int(quality._A), int(quality._B), int(quality._C), (1 << 64) - 1, 64 - quality.BITS
    words = re.findall(r"\w+|[^\w\s]+", text)
    w = [xxhash.xxh64_intdigest(x.lower()) >> 8 for x in words]
    s = [shape(x) + 256 * (k > 0 and w[k] == w[k - 1]) for k, x in enumerate(words)]
    found = Counter((x * a & wrap) >> shift for x in w)
    found.update(((x * a + y * b) * c & wrap) >> shift for x, y in zip(w, w[1:]))
    found.update((((x * b + y) * c + z) * a & wrap) >> shift for x, y, z in zip(s, s[1:], s[2:]))
    size = sum(n * n for n in found.values()) ** 0.5
    return {k: n / size for k, n in found.items()}


def plain_scores(texts, labels, order, alpha=0.5, beta=1.0, l1=0.02, l2=0.1):
    """FTRL-proximal as published, a coordinate at a time, with the intercept as a feature of its own."""
    from math import copysign, exp, sqrt

    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - copysign(l1, z[k])) / ((beta + sqrt(n[k])) / alpha + l2)

    def features(text):
        return {**slots_of(text), "one": 1.0}

    def score(text):
        return 1 / (1 + exp(-sum(weight(k) * v for k, v in features(text).items())))

    for _ in range(quality.EPOCHS):
        for doc in order:
            x = features(texts[doc])
            p = 1 / (1 + exp(-sum(weight(k) * v for k, v in x.items())))
            old = {k: weight(k) for k in x}
            for k, v in x.items():
                g = (p - labels[doc]) * v
                before = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (sqrt(before + g * g) - sqrt(before)) / alpha * old[k]
                n[k] = before + g * g
    return {doc: score(text) for doc, text in texts.items()}


def test_scores_equal_plain_ftrl(spark):
    import random

    r = random.Random(3)
    words = {1: "the house stands by a river and people walk along its banks".split(), 0: "click HERE buy buy now !!! $$$ free win 100 %% now".split()}
    labels = {k: k % 2 for k in range(80)}
    texts = {k: " ".join(r.choice(words[labels[k]] + words[1]) for _ in range(r.randint(0, 40))) for k in range(80)}
    rows = [(k, t, 0.5) for k, t in texts.items()]
    docs = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string, held_out double")
    given = spark.createDataFrame([(k, v, "c") for k, v in labels.items() if k < 60] + [(70, None, "c")], "doc_id long, quality int, predicted string")
    order = [x.doc_id for x in docs.where("doc_id < 60").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("quality"))).collect()]
    got = {x.doc_id: x.score for x in quality.score(docs, quality.fit(docs, given, F.lit(True))).collect()}
    want = plain_scores(texts, labels, order)
    assert got == pytest.approx(want, abs=1e-6)
    assert max(want.values()) > 0.65 > 0.45 > min(want.values())


def test_learning_does_not_depend_on_the_order_of_rows(spark):
    rows = [(k % 40, f"{'good words' if k % 2 else 'BAD !!'} {k}") for k in range(200)]  # five texts of each id
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    first, second = (quality.fit(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels, F.lit(True)) for x, n in ((rows, 3), (rows[::-1], 7)))
    assert first.tobytes() == second.tobytes() and np.count_nonzero(first)


def brute_profile(text):
    """Counts of n-grams within padded words, by the definition."""
    from collections import Counter

    padded = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    out = Counter()
    for k in range(len(padded)):
        for n in (1, 2, 3):
            gram = padded[k : k + n]
            if len(gram) == n and (gram[1] != " " if n == 3 else gram.strip()):
                out[gram] += 1
    return out


def test_grams_are_those_of_padded_words():
    for text in ("Hello, wörld", "a", "12 ab-c  d", "", "x" * 40):
        grams, n = language.counts(text)
        assert sorted(n.tolist()) == sorted(brute_profile(text).values())
        assert len(grams) == len(brute_profile(text))


def test_long_texts_count_the_same_in_blocks(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 300
    whole = language.counts(text)
    monkeypatch.setattr(language, "BLOCK", 1000)
    parts = language.counts(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def hashed(gram):
    """The 32-bit hash of an n-gram of letters and spaces, as its definition says."""
    k1, k2, k3, wrap = int(language._K1), int(language._K2), int(language._K3), (1 << 64) - 1
    c = [ord(x) for x in gram]
    return ([c[0] * k1, c[0] * k2 + c[-1] * k1, (c[0] * k3 + c[len(c) // 2] * k2 + c[-1] * k1) * k3][len(c) - 1] & wrap) >> 32


def top_grams(profile):
    return [g for g, _ in sorted(profile.items(), key=lambda x: (-x[1], hashed(x[0])))[: language.RANKS]]


def test_predictions_equal_brute_force(spark, monkeypatch):
    import random
    from collections import Counter

    r = random.Random(6)
    monkeypatch.setattr(language, "HELD", 50)
    words = {"en": "the and that house with water over".split(), "de": "und der die haus mit wasser über".split(), "fr": "et le la maison avec eau été".split(), "en2": "the and that house with water over".split()}
    rows = []
    for k in range(120):
        lang = ("en", "de", "fr", None)[k % 4]
        rows.append((k, " ".join(r.choice(words[lang or "fr"] + words["en"][:2]) for _ in range(r.randint(0, 12))) + r.choice(["", " 12!", "\n"]), lang))
    rows += [(200 + k, text, "en2") for k, (_, text, lang) in enumerate(rows) if lang == "en"]  # a language that ties with another
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in language.predict(docs, language.learn(docs, F.col("doc_id") % 4 != 3)).collect()}
    profiles = {}
    for k, text, lang in rows:
        if lang and k % 4 != 3:
            profiles.setdefault(lang, Counter()).update(brute_profile(text))
    profiles = {lang: top_grams(p) for lang, p in profiles.items()}
    for k, text, _ in rows:
        own = top_grams(brute_profile(text))
        far = {lang: sum(abs(p.index(g) - i) if g in p else language.RANKS for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        want = (best, 1 - far[best] / (language.RANKS * len(own))) if own else ("und", 0.0)
        assert got[k][0] == want[0] and got[k][1] == pytest.approx(want[1]), (k, text)


def test_ties_between_languages_go_to_the_smaller_name(spark):
    docs = spark.createDataFrame([(1, "ein haus", "b"), (2, "ein haus", "a"), (3, "haus", None)], "doc_id long, text string, lang string")
    got = language.predict(docs, language.learn(docs, F.lit(True))).collect()
    assert {x.lang_pred for x in got} == {"a"}


def test_language_of_odd_rows(spark):
    rows = [(k, "der die das und ist nicht ein eine " * 3, "de", "c") for k in range(5)] + [(10 + k, "the and of to in is that it was for " * 3, "en", "c") for k in range(5)]
    odd = [(20, None, "en", "c"), (21, "", None, "c"), (22, "123 !!", None, "c"), (23, "und das ist die", None, "c"), (23, "und das ist die", None, "c"), (None, "that was the", None, "c")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string")
    got = language.predict(docs, language.learn(docs, F.col("doc_id") < 20)).collect()
    named = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(rows) + len(odd)
    assert [named[k] for k in (20, 21, 22)] == ["und"] * 3 and named[23] == "de" and named[None] == "en"
    assert {r.lang_pred for r in language.predict(docs, language.learn(docs.limit(0), F.lit(True))).collect()} == {"und"}
