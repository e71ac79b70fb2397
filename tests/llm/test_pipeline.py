"""The pipeline on a small folder of tables: each stage's decisions take effect and clean documents stay."""

import random

import corpus_pipeline


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 7))) for _ in range(n))


def folder(spark, path, rows, labels, bench):
    for name, data, schema in (
        ("documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", bench, "item_id bigint, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_pipeline(spark, tmp_path):
    r, rows, labels = random.Random(1), [], []
    for i in range(300):
        words, toxic = prose(i).split(), i % 4 == 0
        if toxic:
            for b in r.choices(["vilezz", "grotzk"], k=4):
                words.insert(r.randrange(len(words)), b)
        rows.append((i, " ".join(words), "en", f"s{i % 3}" if i % 7 else None, 1))
        labels.append((i, 1, int(toxic)))
    bench = [(1, prose(9001, 30))]
    rows += [(1000, rows[1][1], "en", "s0", 1), (1001, rows[2][1].upper(), "en", "s0", 1),
             (1002, prose(77) + " " + bench[0][1] + " " + prose(78), "en", "s1", 1),
             (None, prose(5000), None, None, None), (1003, None, None, None, None), (1004, "", None, None, None)]
    d = folder(spark, tmp_path, rows, labels, bench)
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        kept[name] = {x.doc_id for x in docs.collect()}
    toxic = {i for i in range(300) if i % 4 == 0}
    clean = {i for i in range(300) if i % 4}
    assert len(kept["toxicity"] & toxic) <= 3 and len(clean - kept["toxicity"]) <= 3
    assert kept["exact_dedup"] == kept["toxicity"] - {1, 2, 1003}
    assert kept["near_dedup"] == kept["exact_dedup"]
    assert kept["decontamination"] == kept["near_dedup"] - {1002}
    assert kept["mixing"] <= kept["decontamination"] and len(kept["mixing"]) > 50
    assert corpus_pipeline.run(spark, d).count() == len(kept["mixing"])


def test_pipeline_of_empty_tables(spark, tmp_path):
    d = folder(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, d).count() == 0
