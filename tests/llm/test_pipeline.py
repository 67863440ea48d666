"""The pipeline stage by stage on a small folder of tables."""

import random

import corpus_pipeline
from planloom.llm import queries


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    item = " ".join(word() for _ in range(30))
    rows, labels = [], []
    for i in range(300):
        text = " ".join(word() for _ in range(60))
        toxic = i % 5 == 0
        rows.append((i, f"header line\n{text}" + " vermin" * toxic, "en", "s", 0))
        labels.append((i, 0, int(toxic)))
    rows += [(400 + i, rows[1][1].replace(rows[1][1].split()[9 + i], "other"), "en", "s", 0) for i in range(5)]
    rows += [(500, f"before words {item} after words", "en", "s", 0), (501, None, None, None, None), (502, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{k}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert set(kept["toxicity"]) == {r[0] for r in rows if "vermin" not in (r[1] or "")}
    assert set(kept["line_dedup"]) == set(kept["toxicity"])
    assert not any("header" in r.text for r in kept["line_dedup"].values())
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"].values())
    assert set(kept["line_dedup"]) - set(kept["simhash_near_dedup"]) == {400, 401, 402, 403, 404, 502}
    assert set(kept["simhash_near_dedup"]) - set(kept["decontamination"]) == {500}
    assert set(kept["sentencepiece"]) == set(kept["decontamination"])
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in kept["sentencepiece"].values())


SCHEMAS = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}


def tables(spark, folder, **rows):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, tables(spark, tmp_path))
    assert out.count() == 0 and "doc_id" in out.columns


def test_nulls_repeated_rows_and_very_long_texts(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    long, some, tie = text(60_000), text(50), text(40)
    rows = [(1, long, "en", "s", 0), (2, some, None, None, None), (2, some, None, None, None), (None, text(30), "en", "s", 1), (None, None, None, None, None), (3, "", "en", "s", 0), (5, tie, "en", "s", 0), (4, tie.upper(), "de", "t", 0)]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, documents=rows, labels=[(1, None, None), (9, 1, 1), (2, 1, 0)])).collect()
    # One row of each group stays: of the repeated row one, of the texts alike but for case the smaller id, of those without words the one with an id.
    assert sorted((r.doc_id is None, r.doc_id) for r in out if r.doc_id is not None) == [(False, 1), (False, 2), (False, 3), (False, 4)]
    assert sum(r.doc_id is None for r in out) == 1 and all(r.round_trip for r in out)


def test_registered():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(queries.QUERIES) or len(queries.QUERIES) == 10
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
