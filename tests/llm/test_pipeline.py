"""The pipeline's stages keep the columns of documents, and the last one packs what the others kept."""

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == cp.COLUMNS, name
        docs = cp.materialize(docs, name)
        kept.append(docs.count())
    assert kept[0] >= kept[1] >= kept[2] > 0
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = cp.run(spark, SF).toPandas()
    assert set(packed.doc_id) == ids and packed.groupby("sequence_id").length.sum().max() <= 2048
