import zlib

import numpy as np

from tessella.llm import quality_model, toxicity
from tessella.llm._boost import Boost, auc, isotonic
from tests.llm.common import docs, empty, rows

SF = "/root/testdata/sf0.1"


def tables(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_boost_learns_and_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(int)
    z = Boost(trees=40).fit(x[:2000], y[:2000]).decide(x[2000:])
    assert auc(z, y[2000:]) > 0.98
    knots, values = isotonic(z, y[2000:])
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all() and 0 <= values.min() <= values.max() <= 1


def test_rules_compile_to_the_same_score(spark):
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) | (x[:, 1] < 0.1)).astype(int)
    model = quality_model.fit_rules(x, y, ["a", "b", "c"])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    got = {r.i: r.s for r in df.select("i", model.column().alias("s")).collect()}
    want = model.decide(x)
    assert max(abs(got[i] - want[i]) for i in range(len(x))) < 1e-9
    assert auc(want, y) > 0.97 and len(model.rules) < 60


def test_statistics(spark):
    df = quality_model.statistics(docs(spark))
    assert df.count() == len(rows()) and set(docs(spark).columns) <= set(df.columns)
    r = quality_model.statistics(spark.createDataFrame([("A b a b! c\nA b\n",)], "text string")).first()
    assert (r.words, r.lines) == (7, 3 / 7) and abs(r.word_length - 8 / 7) < 1e-9 and abs(r.distinct_pairs - 5 / 6) < 1e-9
    assert abs(r.upper - 2 / 8) < 1e-9 and abs(r.shouting - 1 / 7) < 1e-9


def accuracy(spark, out, label):
    held = out.filter("held_out").join(tables(spark, "labels"), "doc_id").collect()
    y, s, p = (np.array([r[c] for r in held]) for c in (label, "score", "predicted"))
    return auc(s, y), ((p == 0) & (y == 1)).mean(), ((p == 1) & (y == 0)).mean()


def test_held_out_quality(spark):
    area, wrong_out, _ = accuracy(spark, quality_model.quality_digest(tables(spark), tables(spark, "labels")), "quality")
    assert area > 0.99 and wrong_out < 0.005


def test_held_out_toxicity(spark):
    area, missed, wrong = accuracy(spark, toxicity.toxicity_digest(tables(spark), tables(spark, "labels")), "toxic")
    assert area > 0.98 and missed < 0.02 and wrong < 0.005


def test_labels_of_held_out_rows_are_not_read(spark):
    labels = tables(spark, "labels")
    some = tables(spark).limit(1500)
    from pyspark.sql import functions as F

    for digest, held, column in ((quality_model.quality_digest, F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "quality"), (toxicity.toxicity_digest, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "toxic")):
        changed = labels.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)))
        a, b = ({r.doc_id: r.score for r in digest(some, x).collect()} for x in (labels, changed))
        assert a == b
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % (3 if column == "quality" else 5) == (column == "quality")) for r in digest(some, labels).limit(200).collect())


def test_disguised_words():
    lookup = toxicity.Lookup({})
    x = dict(zip(toxicity.FEATURES, toxicity.features("You are an 1d1ot and a m0ron, you m0r0n! IDIOT", lookup), strict=True))
    assert x["disguised_hits"] == 2 and x["seed_count"] == 1 and x["exclaims"] > 0 and x["second_density"] > 0


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 1), (4, 1, 1), (7, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for digest in (quality_model.quality_digest, toxicity.toxicity_digest):
        for known in (labels, labels.limit(0)):
            out = digest(docs(spark), known).collect()
            assert len(out) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
        assert digest(empty(spark), labels).count() == 0
    kept = quality_model.drop_low_quality(docs(spark), labels.limit(0))
    assert kept.columns == docs(spark).columns and kept.count() == len(rows())


def plain_features(text, lexicon):
    """The features again, word by word, from their definitions."""
    import re

    text = text or ""
    words = re.findall(r"[^\W\d_]+", text.lower())
    n = max(1, len(words))
    starts = lambda w: [w + "$"] + [w[:k] for k in range(4, 9) if k <= len(w)]
    seeds = [i for i, w in enumerate(words) if w in toxicity.SEED]
    weight = {i: max([lexicon.get(s, 0.0) for s in starts(w)], default=0.0) for i, w in enumerate(words)}
    learned = [i for i in weight if weight[i] > 0]
    second = [i for i, w in enumerate(words) if w in toxicity.SECOND]
    hits = sorted(set(seeds) | set(learned))
    near = sum(any(0 <= i - j <= 5 for j in second) for i in hits) + sum(any(0 < i - j <= 5 for j in hits) for i in second)
    capitals = [len(c) for c in re.findall("[A-ZÀ-ÖØ-Þ]+", text)]
    letters = max(1, sum(map(len, words)))
    signs = [t for t in re.split(r"[^\w@$!|*]|_", text) if re.search(r"[^\W\d_][0-9@$!|*]+[^\W\d_]", t) and not toxicity.is_code(t)]
    plain = [t.lower().translate(toxicity.DISGUISE) for t in signs]
    found = sum(w in toxicity.SEED or any(s in lexicon for s in starts(w)) for w in plain)
    return [len(seeds) / n, len(seeds), len(learned) / n, len(learned), max(weight.values(), default=0.0), sum(weight.values()), near, len(second) / n, sum(capitals) / letters, sum(k > 2 for k in capitals) / n, sum(c in "!?" for c in text) / n, sum(c in ".,;:*#$%&|" for c in text) / n, len(plain) / n, found, np.log1p(len(words))]


def test_features_equal_their_definitions(spark):
    lexicon = {"worth": 3.0, "trash$": 2.5, "nation": 2.2}
    texts = ["You worthless tr4sh, YOU are a m0r0n!", "", None, "a\tst p1d/you/1d10t " + "x" * 90 + "0" + "y" * 90, "f00dcafe" * 8 + " aB3dE5fG7hI9jK1lM3", "WHY?? du Idiot; Nation"]
    texts += [r.text for r in tables(spark).orderBy("doc_id").limit(300).collect()]
    lookup = toxicity.Lookup(lexicon)
    for text in texts:
        assert np.allclose(toxicity.features(text, lookup), plain_features(text, lexicon), atol=1e-9), text
    long_ = dict(zip(toxicity.FEATURES, toxicity.features("x" * 50 + " " + "l0ser" + " " + "z" * 60 + "1" + "z" * 60, lookup), strict=True))
    assert long_["disguised_hits"] == 1 and long_["disguised"] > 0


def test_training_rows_are_determined(spark):
    """Ids that stand with several texts and labels, under other partitionings: the same scores."""
    labels = tables(spark, "labels")
    some = tables(spark).filter("doc_id < 1200")
    twice = some.unionByName(some.filter("doc_id % 3 = 0").selectExpr("doc_id", "concat('zz ', text) as text", "lang", "source", "n_chars"))
    both = labels.unionByName(labels.filter("doc_id % 4 = 0").selectExpr("doc_id", "1 - quality as quality", "1 - toxic as toxic"))
    for digest in (quality_model.quality_digest, toxicity.toxicity_digest):
        a, b = (sorted(map(tuple, digest(twice.repartition(n), both.repartition(m)).collect())) for n, m in ((1, 3), (5, 2)))
        assert a == b


def test_quality_statistics_and_scores_equal_plain_python(spark):
    """Every statistic from its definition, and the compiled column against the rules on them."""
    import re

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_model.train(df, labels)
    names = list(quality_model.STATISTICS)
    stats = {r.doc_id: [r[n] for n in names] for r in quality_model.statistics(df).collect()}
    x = []
    texts = {r.doc_id: r.text for r in df.collect()}
    for i, t in sorted(texts.items()):
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
        w, bare = max(1, len(words)), max(1, sum(map(len, words)))
        pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else len(words)
        own = [len(words), sum(map(len, words)) / w, pairs / max(1, len(words) - 1), len(re.findall(r"[#*$%&|<>=@~^_+]", t)) / bare, len(re.findall("[!?]", t)) / w, len(re.findall("[A-ZÀ-ÖØ-Þ]", t)) / bare, len(re.findall("[0-9]", t)) / bare, len(re.findall("[.,;:]", t)) / w, len(lines) / w, len(set(lines)) / len(lines)]
        assert np.allclose(stats[i], own, atol=1e-12), i
        x.append(stats[i])
    score = dict(zip(sorted(texts), model.decide(np.array(x)), strict=True))
    for r in quality_model.quality_digest(df, labels).collect():
        assert abs(r.score - score[r.doc_id]) < 1e-9 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
