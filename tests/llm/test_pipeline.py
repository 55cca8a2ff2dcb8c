"""The pipeline's stages on a small table, planted cases included."""

import corpus_pipeline
from stockyard.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()
    some = docs.filter("n_chars > 400").orderBy("doc_id").first()
    rows = [(90_000, some.text, "en", "src0", 1), (90_001, some.text + " more", "en", "src1", 1),
            (90_002, f"Start of it. {item.text} Then an end of it that stays.", "en", "src1", 1),
            (90_003, "12 34 !!", "en", "src1", 1), (90_004, None, None, None, None),
            (90_005, "Set token=Zx81Qw92Er73Ty64Ab now, said the man of the house.", "en", "src2", 1)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    assert not {90_003, 90_004} & ids("language_id") and 90_002 in ids("language_id")
    assert not {90_000, 90_001} & ids("near_dedup") and some.doc_id in ids("near_dedup")
    text = {r.doc_id: r.text for r in seen["secret_scan"].collect()}
    assert text[90_002].startswith("Start of it. ") and text[90_002].endswith("Then an end of it that stays.")
    assert item.text not in text[90_002] and "Zx81Qw92" not in text[90_005] and "[REDACTED]" in text[90_005]
    assert {r.doc_id for r in seen["packing"].collect()} == ids("secret_scan")


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    numbers = {n.split("_")[0] for n in queries.QUERIES}
    assert numbers == {f"op{i}" for i in range(1, 14)} and set(queries.ORACLE) <= set(queries.QUERIES)
