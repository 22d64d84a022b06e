import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.llm import language_id as li
from rosterlens.llm.labelled import labelled_sample, remainder
from rosterlens.llm.quality import boosted_rules, fit_quality, holds, lasso, quality_scores
from rosterlens.llm.queries import QUERIES
from rosterlens.llm.toxicity import fit_toxicity, grams, toxicity_scores

FOLDER = "/root/testdata/sf0.01"


def held_out(spark, query, label):
    docs = QUERIES[query](spark, FOLDER)
    return docs.where("held_out").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").select("predicted", label)


def test_quality_of_held_out_rows(spark):
    rows = held_out(spark, "op1_quality", "quality").collect()
    assert np.mean([r[0] == r[1] for r in rows]) > 0.9
    assert np.mean([r[0] for r in rows if r[1] == 1]) > 0.95


def test_toxicity_of_held_out_rows(spark):
    rows = held_out(spark, "op2_toxicity", "toxic").collect()
    assert np.mean([r[0] == r[1] for r in rows]) > 0.88
    assert np.mean([r[0] for r in rows if r[1] == 0]) < 0.1


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = QUERIES["op5_language_id"](spark, FOLDER).where("held_out").join(docs, "doc_id").select("lang", "lang_pred").collect()
    assert np.mean([r[0] == r[1] for r in rows]) > 0.95


def test_rules_and_their_compiled_form_agree(spark, make):
    good, bad = "Some quiet prose with words. " * 5, "BUY!!! $$$ NOW!!! "
    docs = make([(i, (good if i % 2 else bad) + str(i)) for i in range(400)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = fit_quality(labelled_sample(docs, labels, "quality", F.lit(True), "doc_id", "text"))
    assert model.rules
    got = {r.doc_id: r.score for r in quality_scores(docs, model).collect()}
    assert all((got[i] >= 0.3) == bool(i % 2) for i in got)


def test_lasso_is_sparse_and_trees_find_the_split():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = (x[:, 2] > 0.5).astype(float)
    rules = boosted_rules(x, y, 6, 2)
    features = np.array([holds(r, x) for r in rules], np.float32).T
    _, weights = lasso(features, y, 5e-3)
    assert 0 < (np.abs(weights) > 1e-3).sum() < len(rules)
    assert any(c[0] == 2 and abs(c[2] - 0.5) < 0.05 for r in rules for c in r)


def test_scores_of_odd_rows(odd, odd_pairs, none):
    some = odd.where("doc_id < 9")
    labels = some.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).distinct()
    for fit, score, label in ((fit_quality, quality_scores, "quality"), (fit_toxicity, toxicity_scores, "toxic")):
        for of in (labels, labels.limit(0), labels.withColumn(label, F.lit(None).cast("int"))):
            model = fit(labelled_sample(odd, of, label, F.lit(True), "doc_id", "text"))
            out = score(odd, model, score_col="mark")
            assert out.columns == [*odd.columns, "mark"]
            assert out.where("mark between 0 and 1").count() == len(odd_pairs)
            assert score(none, model).count() == 0
    # Without labels nothing is called toxic, and nothing bad.
    assert toxicity_scores(odd, fit_toxicity(labelled_sample(odd, labels.limit(0), "toxic", F.lit(True), "doc_id", "text"))).first().score < 0.3


def test_sample_is_bounded_and_by_id(make, spark):
    docs = make([(i, "t") for i in range(300)] + [(None, "t")])
    labels = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(None, 1), (7, 1)], "doc_id long, toxic int")
    usable = remainder(F.col("doc_id"), 4) != 2
    rows = labelled_sample(docs, labels, "toxic", usable, "doc_id", "text", rows=50)
    assert rows.count() == 50 and {r.label for r in rows.collect()} == {0, 1}
    assert {r[0] for r in docs.select(remainder(F.col("doc_id"), 4)).distinct().collect()} == {0, 1, 2, 3, None}


def test_grams_mark_the_edges():
    assert {"<id", "<idi", "ot>", "idiot"} <= grams('"Idiot!"')
    assert grams("...") == set()


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    model = li.ByteGRU.fresh(["a", "b", "c"], 4)
    for p in model.parameters:
        p[...] = p.astype(np.float32)
    rows = rng.integers(0, 256, (6, li.WINDOW)).astype(np.int16)
    rows[0, 50:] = li.PAD
    label = np.array([0, 1, 2, 0, 1, 2])
    wide = li.ByteGRU(model.languages, *(p.astype(np.float64) for p in model.parameters))
    valid = (rows != li.PAD).T

    def loss():
        labels = wide.probabilities(rows)
        return -(np.log(labels[:, label, np.arange(6)]) * valid).sum() / valid.sum()

    for p, g in zip(wide.parameters, wide.gradients(rows, label)):
        flat, at = p.reshape(-1), rng.integers(p.size)
        at = int(np.abs(g).argmax()) if p.size > 100 else at
        before = flat[at]
        flat[at] = before + 1e-2
        up = loss()
        flat[at] = before - 1e-2
        down = loss()
        flat[at] = before
        assert (up - down) / 2e-2 == pytest.approx(float(g.reshape(-1)[at]), rel=0.1, abs=2e-4)


def test_languages_of_odd_rows(odd, odd_pairs, none, make):
    texts = {"xx": "abab baba abba ", "yy": "xyzz zyxx yyxz "}
    docs = make([(i, texts["xx"] * (i % 7 + 3)) for i in range(60)], lang="xx").union(
        make([(100 + i, texts["yy"] * (i % 7 + 3)) for i in range(60)] + [(999, None)], lang="yy")
    )
    model = li.fit_language(docs, F.lit(True), passes=3)
    assert model.languages == ["xx", "yy"]
    got = {r.id: (r.lang_pred, r.score) for r in li.languages(docs, model).collect()}
    assert all(got[i][0] == ("xx" if i < 100 else "yy") and 0.5 <= got[i][1] <= 1 for i in got if i != 999)
    assert got[999] == ("und", 0.0)
    out = li.languages(odd, model).collect()
    assert len(out) == len(odd_pairs)
    assert {r.lang_pred for r in out if r.id in (2, 3, 4, 8, 12)} == {"und"}
    assert li.languages(none, model).count() == 0
    untaught = li.fit_language(none, F.lit(True))
    assert {r.lang_pred for r in li.languages(odd, untaught).collect()} == {"und"}


def test_rare_telling_grams_are_not_pushed_out(spark):
    rng = np.random.default_rng(3)
    common = " ".join("".join(rng.choice(list("abcdefghijklmnop"), 8)) for _ in range(5_000))
    assert len(set().union(*map(grams, common.split()))) > 65_536
    rows = [(int(i < 20), common + (" zzyzzx" if i < 14 else "")) for i in range(40)]
    assert "zzyzzx" in fit_toxicity(spark.createDataFrame(rows, "label int, text string")).numbers
