import __spark_entry__
import corpus_pipeline as P
from strandlake.llm.decontamination import find_leaks
from strandlake.llm.simhash_dedup import near_copies

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
            assert docs.join(before, columns, "left_anti").count() == 0
        if k == 1:
            assert docs.selectExpr("count(*) = count(distinct translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))").first()[0]
        if k == 2:
            assert near_copies(docs).selectExpr("count(*) = count(distinct component_id)").first()[0]
        if k == 3:
            assert find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
            kept = docs
    assert docs.selectExpr("sum(length)").first()[0] == docs.selectExpr("doc_id", "doc_tokens").distinct().selectExpr("sum(doc_tokens)").first()[0]
    assert docs.select("doc_id").distinct().count() == kept.count()


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    """Nulls, empties, repeats, a very long text, and columns named like the operators' own."""
    clash = ["best_tag", "__tag", "__kept", "__gone", "__body", "__score", "__id", "label", "home", "m", "keys", "key", "cell"]
    for source, n in ((odd_docs, 12), (no_docs, 0)):
        path = str(tmp_path / f"in{n}")
        source.selectExpr("*", "'x' AS source", "1 AS n_chars", *[f"'{c}' AS {c}" for c in clash]).write.parquet(path)
        docs = spark.read.parquet(path)
        columns, sizes = docs.columns, []
        for k, (_, stage) in enumerate(P.STAGES):
            out = str(tmp_path / f"{n}-{k}")
            stage(spark, docs, SF).write.parquet(out)
            docs = spark.read.parquet(out)
            sizes.append(docs.count())
            assert k == 4 or docs.columns == columns
        assert sizes[:4] == sorted(sizes[:4], reverse=True) and (n or not any(sizes))
    deduplicated = P.exact_dedup(spark, spark.read.parquet(str(tmp_path / "in12")), SF)
    assert deduplicated.count() == 8 and deduplicated.columns == columns


def test_registry_has_eleven_queries():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names


def test_the_quality_stage_sends_a_text_once(spark):
    """No copy of the text stands beside it in the plan of the scoring; other types and cases of the name still work."""
    from strandlake.llm.quality import Model, score_texts

    model = Model(None, None, None, None, None, None, [0.5])
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    assert "encode" not in score_texts(docs, model)._jdf.queryExecution().toString()
    assert [r["__score"] for r in score_texts(docs, model).collect()] == [0.5] * 3
    for odd in (docs.withColumnRenamed("text", "TEXT"), docs.selectExpr("doc_id", "cast(text AS binary) AS text")):
        scored = score_texts(odd, model)
        assert scored.columns == [*odd.columns, "__score"] and scored.count() == 3
