"""The pipeline's stages on nulls, blanks, repeats, long texts, clashing columns and empty tables."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_take_odd_rows_and_empty_tables(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    odd = [(None, None, None, None, None), (None, None, None, None, None), (9001, "", "en", "s", 0), (9002, " \t\n ", None, "s", None), (9003, None, "en", None, None), (9003, "one two three four five six seven", "en", None, 1),
           (9003, "eight nine ten eleven twelve thirteen fourteen", "en", "s", 1), (9004, "word\n" * 3000, "en", "s", 1), (9005, "x" * 5000, "fr", "t", 1), (9005, "x" * 5000, "fr", "t", 1)]
    clash = {"id": F.lit(1), "host": F.lit("h"), "key": F.lit(2), "node": F.lit(3), "component": F.lit(4), "fp": F.lit("f"), "score": F.lit(0.5), "size": F.lit(6), "ids": F.lit("i"), "n": F.lit(7), "part": F.lit(8), "copy": F.lit(9)}
    rows = docs.union(spark.createDataFrame(odd, docs.schema)).withColumns(clash)
    held = rows
    for name, stage in cp.STAGES[:-1]:
        held = cp.stage_table(stage(spark, held, SF))
        assert held.columns == rows.columns, name
        if name != "mixing":
            assert held.filter("doc_id = 9003 and text like 'one two%'").count() == 1, name  # clean documents stay, whatever their id
    kept = {(r["doc_id"], r["text"]) for r in held.collect()}
    assert (9003, "eight nine ten eleven twelve thirteen fourteen") in kept and sum(t is None or not t.split() for _, t in kept) == 1  # all blank rows are copies of one
    last = cp.STAGES[-1][1](spark, held, SF)
    assert last.columns == ["doc_id", "lang", "source", "ids", "n_tokens"] and last.count() == held.count()
    empty = rows.limit(0)
    for _, stage in cp.STAGES:
        empty = cp.stage_table(stage(spark, empty, SF))
        assert empty.count() == 0
