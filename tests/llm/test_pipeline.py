"""The pipeline's stages on a small corpus, and its whole run."""

import random

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    good = [(i, prose(80, i)) for i in range(200)]
    junk = [(i, "$$$ ".join(prose(60, i).split())) for i in range(200, 330)]
    copies = [(400 + i, good[i][1]) for i in range(5)]
    near = [(500 + i, good[10 + i][1] + " tail") for i in range(5)]
    passage = prose(30, 999)
    dirty = [(600 + i, prose(20, 5000 + i) + " " + passage) for i in range(3)]
    rows = [(i, t, "en", "s", len(t)) for i, t in good + junk + copies + near + dirty]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(330)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "tokens"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert sorted(out.columns) == sorted(columns)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r[0] for r in docs.select("doc_id").collect()}
    clean = {i for i, _ in good}
    assert len(left["quality"] & clean) >= 198 and not left["quality"] & {i for i, _ in junk}
    assert left["line_dedup"] == left["quality"]
    assert not left["near_dedup"] & {500 + i for i in range(5) if 10 + i in left["quality"]}
    assert not left["decontamination"] & {600, 601, 602}
    assert left["tokens"] == left["decontamination"] >= (left["quality"] & clean)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(left["tokens"])


EDGE = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "no id at all " * 5), (4, " \n \n"), (5, "long words again " * 20000), (6, "é中😀 ñ"), (-9, "x\ny\nx")]


def test_stages_on_edge_rows_and_clashing_columns(spark, tmp_path):
    good = [(100 + i, prose(60, i)) for i in range(60)]
    junk = [(300 + i, "$$$ ".join(prose(40, i).split())) for i in range(40)]
    columns = COLUMNS + ", key int, h string, own int, found int, k string, bad int"
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 2, 3, "y", 4) for i, t in EDGE + good + junk]
    frame = spark.createDataFrame(rows, columns)
    spark.createDataFrame([(100 + i, 1, 0) for i in range(60)] + [(300 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(20, 9999)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        if name != "tokens":
            assert out.columns == frame.columns
        kept[name] = out.collect()
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0
    ids = lambda name: sorted((r.doc_id is None, r.doc_id or 0) for r in kept[name])
    every = sorted((i is None, i or 0) for i, *_ in rows)
    assert ids("line_dedup") == ids("tokens") == ids("decontamination") == every
    assert [r.text for r in kept["line_dedup"] if r.doc_id == 1] == [None] and len([r for r in kept["line_dedup"] if r.doc_id == 5][0].text) == len(EDGE[6][1])
    assert ids("near_dedup") == sorted({*every} - {(False, 2)})  # null and empty are one text, and so are the repeated rows
    assert {100 + i for i in range(60)} <= {r.doc_id for r in kept["quality"]} and not {300 + i for i in range(40)} & {r.doc_id for r in kept["quality"]}


def test_pipeline_without_labels_and_benchmark(spark, tmp_path):
    spark.createDataFrame([(i, prose(20, i), "en", "s", 0) for i in range(5)], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # a score of one half is below the bound
