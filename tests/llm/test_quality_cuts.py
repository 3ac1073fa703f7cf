"""Clean documents stay, whatever the size and their language's share of the labels."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from terraframe.llm import quality_rules


def test_held_out_scores(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("a b c d e f g".split()) for _ in range(70))) for i in range(8)]
    labels = spark.createDataFrame([(i, 1) for i in range(4)] + [(9, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = quality_rules.trusted_ids(labels)
    counts = quality_rules.gram_counts(docs, good)
    got = sorted(r["s"] for r in quality_rules.held_out_scores(docs, good, counts).collect())
    grams = lambda t: [tuple(g) for w in [re.findall(r"\S+", t)] for g in [*((x,) for x in w), *zip(w, w[1:])]]
    raw = [g for _, t in rows for g in grams(t)]
    want = []
    for i in range(4):
        others = [g for j in range(4) if j != i for g in grams(rows[j][1])]
        share = len(others) / len(raw)
        want.append(np.mean([math.log((others.count(g) / share + quality_rules.PSEUDO) / (raw.count(g) + quality_rules.PSEUDO)) for g in grams(rows[i][1])]))
    assert np.allclose(got, sorted(want), atol=1e-9)


def test_clean_documents_of_each_language_stay(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/labels.parquet")
    out = quality_rules.quality(docs, labels).join(labels.select("doc_id", "quality").dropDuplicates(["doc_id"]), "doc_id", "left")
    clean = out.where("quality is null and not base_failed and n_symbols * 100 < n_words")
    lost = {r["lang"]: r["lost"] for r in clean.groupBy("lang").agg(F.avg((~F.col("kept")).cast("int")).alias("lost")).collect()}
    assert len(lost) == 4 and max(lost.values()) < 0.1
    bad = out.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert bad < 0.1


def test_language_without_trusted_documents_stays(spark):
    rng = random.Random(2)
    text = lambda words: " ".join(rng.choice(words.split()) for _ in range(80))
    rows = [(i, text("the of and house river tree stone light"), "en") for i in range(40)] + [(100 + i, text("der die und haus fluss baum stein licht"), "de") for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    out = quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels)
    assert out.where("lang = 'de' and kept <> (not base_failed)").count() == 0 and out.where("lang = 'de' and kept").count() > 30


def test_clashing_columns_stay(spark):
    rows = [(i, "tree river stone " * 30 + str(i), "x", 7, 1.5, False, i) for i in range(4)] + [(1, None, None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, _words string, n_words int, score double, kept boolean, _row long")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    out = quality_rules.quality(docs, labels)
    names = [f"input_{c}" if c in quality_rules.OWN else c for c in docs.columns]
    assert out.columns == [*names, *quality_rules.OWN]
    assert sorted(map(repr, (tuple(r) for r in out.select(*names).collect()))) == sorted(map(repr, rows))
    assert quality_rules.keep(docs, labels).schema == docs.schema
    assert sorted(r["n_words"] for r in out.collect()) == [0, 0, 91, 91, 91, 91]


def test_repeated_windows_of_both_kinds(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(str(rng.randrange(k)) for _ in range(n))) for k, n in [(2, 40), (4, 300), (9, 2000), (12, 1500), (40, 900), (1, 3), (1, 2), (1, 5), (300, 5000)]]
    rows.append((7, " ".join(str(i % 500) for i in range(3000))))  # more repeats than are looked up one by one
    got = {r["text"]: r["n_repeat_words"] for r in quality_rules.base_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for _, t in rows:
        w = t.split()
        wins = list(zip(w, w[1:], w[2:]))
        seen = {}
        for x in wins:
            seen[x] = seen.get(x, 0) + 1
        assert got[t] == len({k + j for k, x in enumerate(wins) if seen[x] > 1 for j in range(3)})


def test_held_out_scores_fold_numbers_without_a_struct_for_each_gram(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 17}" for k in range(60)), "en") for i in range(6)], "doc_id long, text string, lang string")
    good = quality_rules.trusted_ids(spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, quality int"))
    counts = spark.createDataFrame(quality_rules.gram_counts(docs, good).collect(), quality_rules.gram_counts(docs, good).schema)
    scores = quality_rules.held_out_scores(docs, good, counts)
    folds = [x for x in scores._jdf.queryExecution().optimizedPlan().toString().splitlines() if "_lang" in x and "aggregate(" in x]
    assert folds and not any("struct(" in x for x in folds) and scores.count() == 4
