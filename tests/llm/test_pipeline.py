import pytest

import corpus_pipeline as cp
from rosterlens.llm.decontaminate import contamination
from rosterlens.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture
def folder(spark, odd, tmp_path):
    """A folder of tables with odd rows; the labels call some words toxic."""
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some plain words and more of them a second line")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_keep_the_columns(spark, folder, odd_pairs):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        left[name] = out.count()
        if name != "packing":
            assert out.schema.names == docs.schema.names
            assert out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            docs = spark.createDataFrame(out.collect(), docs.schema)
    assert left["toxicity"] == len(odd_pairs) == left["line_dedup"]
    # One of the equal texts goes, and the document that is all benchmark.
    assert left["near_dedup"] >= len(odd_pairs) - 1
    assert left["decontamination"] == left["near_dedup"] - 1


def test_empty_tables(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_decisions_take_effect(spark):
    """On real tables: no copy of a document and no benchmark passage is left, and most documents stay."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(cp.STAGES)
    near = stages["near_dedup"](spark, docs, FOLDER)
    assert near.select("text").distinct().count() == near.count() > 0.8 * docs.count()
    clean = stages["decontamination"](spark, docs, FOLDER)
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert contamination(clean, bench).where("n_hit > 0").count() == 0
    hit = contamination(docs, bench).where("n_hit > 0").count()
    assert clean.count() == docs.count() - hit


def test_one_row_of_a_near_group_stays(spark, make):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = make([(None, a), (None, a + " more"), (3, b), (3, b), (3, b + " more"), (None, b), (None, "own words here"), (None, None), (None, "")])
    left = [(r.doc_id, r.text) for r in dict(cp.STAGES)["near_dedup"](spark, docs, FOLDER).collect()]
    alone = [(None, "own words here"), (None, None), (None, "")]
    assert [x for x in alone if x not in left] == [] and len(left) == 5
    assert sum(x in ((None, a), (None, a + " more")) for x in left) == 1
    assert sum(x in ((3, b), (3, b + " more")) for x in left) == 1


def test_every_dealt_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(SQL) <= set(QUERIES)
