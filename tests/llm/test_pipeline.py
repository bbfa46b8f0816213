"""The pipeline: what each stage keeps, and rows of every odd kind."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, items string, predicted int"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents with planted toxic, copied, contaminated and personal ones, and tables beside them."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(1200):
        t = text(rng.randint(20, 60))
        if bad := i % 6 == 0:
            t = t.replace(" ", " vilestuff ", 1)
        rows.append((i, t))
        labels.append((i, int(bad)))
    item = " ".join(f"q{k}" for k in range(30))
    copy = text(80)
    rows += [(2000, copy), (2001, copy), (2002, copy + " tail"), (2003, f"{text(40)} {item}"), (2004, f"{text(900)} {item} {text(9)}"), (2005, f"write to a.b@example.com {text(30)}"), (2006, None), (2007, ""), (None, text(30)), (2008, text(6000))]
    folder = str(tmp_path_factory.mktemp("made"))
    documents = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in rows], SCHEMA)
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows), item


def test_each_stage(spark, made, tmp_path):
    folder, texts, item = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(kept[name])
        if name != "pieces":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    clean = {i for i in range(1200) if i % 6}
    special = set(range(2000, 2009)) | {None}
    toxic_left = set(kept["toxicity"]) - clean - special
    assert clean | special <= set(kept["toxicity"]) and len(toxic_left) < 10
    assert set(kept["toxicity"]) - set(kept["near_dedup"]) == {2001, 2002}
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {2003}
    long = kept["decontamination"][2004]
    assert item not in long.text and long.n_chars == len(long.text) == len(texts[2004]) - len(item)
    masked = kept["personal_data"]
    assert set(masked) == set(kept["decontamination"]) == set(kept["pieces"])
    assert masked[2005].text.startswith("write to <EMAIL> ") and masked[2005].n_chars == len(masked[2005].text)
    assert masked[2006].text is None and masked[2007].text == "" and masked[2008].text == texts[2008]
    assert all(r.lossless for r in kept["pieces"].values())


def test_run_over_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_gives_the_last_stage(spark, made):
    out = corpus_pipeline.run(spark, made[0])
    assert {"doc_id", "n_tokens", "lossless"} <= set(out.columns) and out.count() > 900
