"""The stages on planted documents: what they drop, what they keep, and the columns that they return."""

import numpy as np
import pytest

import corpus_pipeline
from kilnspark.llm import packing, secrets
from kilnspark.llm.common import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in ("ri", "sto", "mea", "clo", "har", "lan") for b in ("ver", "ne", "dow", "ud", "bor", "tern", "ow", "el")]
    rows, labels = [], []
    for i in range(500):
        text = [str(w) for w in rng.choice(words, 80)]
        bad, toxic = i % 5 == 1, i % 9 == 2
        if toxic:
            text[40] = "zounds"
        if bad:
            text = [w.upper() + "!!%%" for w in text]
        if i == 400:
            text[3] = "token=abcdefgh12"
        rows.append((i, " ".join(text), "en", "s", 1))
        if i < 300:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "s", 1) for i in (0, 3, 5)]  # exact copies of clean documents
    for i in (0, 3, 5):  # near copies: one word of eighty
        near = rows[i][1].split()
        near[20] = "other"
        rows.append((2000 + i, " ".join(near), "en", "s", 1))
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "simhash near-dedup", "secret scans", "best-fit packing"]


def test_stages_one_by_one(spark, planted):
    folder, rows = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality classifier"](spark, docs, folder)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    clean = {r[0] for r in rows if "%%" not in r[1]}
    assert kept == clean
    mild = {r["doc_id"] for r in stage["toxicity"](spark, docs, folder).collect()}
    assert mild == {r[0] for r in rows if "zounds" not in r[1].lower()}
    single = stage["simhash near-dedup"](spark, docs, folder)
    assert single.columns == docs.columns
    ids = {r["doc_id"] for r in single.collect()}
    assert ids == {r[0] for r in rows if r[0] < 1000}
    masked = {r["doc_id"]: r["text"] for r in stage["secret scans"](spark, docs, folder).collect()}
    assert all(masked[r[0]] == r[1] for r in rows if not secrets.find_spans(r[1]))
    assert "[SECRET]" in masked[400] and "abcdefgh12" not in masked[400]


def test_run_is_the_stages_in_turn(spark, planted):
    folder, rows = planted
    got = corpus_pipeline.run(spark, folder).collect()
    clean = {r[0] for r in rows if "%%" not in r[1] and "zounds" not in r[1].lower() and r[0] < 1000}
    assert {r["doc_id"] for r in got} == clean
    e = packing.WordEncoder(packing.tokenizer_path())
    masked = {r[0]: r[1].replace("token=abcdefgh12", "[SECRET]") for r in rows}
    assert all(r["length"] == len(e.encode(masked[r["doc_id"]])) // 4 + 1 for r in got)


def test_results_and_tables_have_few_files(spark, planted):
    """Each file costs the executor a process that shows its memory twice: hundreds of small partitions are laid end to end, no row is lost."""
    folder, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(211)
    for name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, folder).rdd.getNumPartitions() <= 32, name
    table = materialize(spark.range(2000, numPartitions=211), "few-files")
    assert len(table.inputFiles()) <= 32
    assert sorted(r["id"] for r in table.collect()) == list(range(2000))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
