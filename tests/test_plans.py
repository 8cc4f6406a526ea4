"""Plan-shape guards for the scale design (checked on the executed physical plan)."""


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _corpus(spark):
    from quarry.sources.corpus import corpus_from_table
    rows = [(i, f"src/m{i % 7}/f{i}.py", f'x = {i}\ntoken = "ab{i:04x}"\n') for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, p string, t string").repartition(4)
    return corpus_from_table(df, "p", "t", doc_id="id")


def test_scan_phase_never_shuffles_content(spark):
    from quarry.operators import analysts as A
    from quarry.operators import targets as TG
    from quarry.operators.filters import kept_files
    df = _corpus(spark)
    base = _plan(df)
    fanned = TG.fan_out(kept_files(df), *TG.registry_maps())
    res = A.rule_results(fanned, TG.prompt_catalog(spark))
    plan = _plan(res)
    # nothing beyond the input's own exchange: no new hash partitioning, no sort-merge join
    assert plan.count("Exchange hashpartitioning") == base.count("Exchange hashpartitioning")
    assert plan.count("Exchange RoundRobinPartitioning") == base.count("RoundRobinPartitioning")
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert res.where("result like '%token%'").count() > 0


def test_work_list_hashes_each_file_once(spark):
    from quarry.operators import targets as TG
    from quarry.operators.filters import kept_files
    fanned = TG.fan_out(kept_files(_corpus(spark)), *TG.registry_maps())
    plan = TG.scan_targets(fanned)._jdf.queryExecution().optimizedPlan().toString()
    gen = plan.index("Generate")
    # the md5 of the content is computed below the category explode (once per file)
    assert "md5" not in plan[:gen] and "md5" in plan[gen:]


def test_top_k_is_limited_before_the_shuffle(spark):
    from pyspark.sql import functions as F
    from quarry.plans import report as RP
    b = spark.range(1000).select(
        (F.col("id") % 3).cast("string").alias("scanner"),
        (F.col("id") % 97).cast("string").alias("file"),
        F.lit(True).alias("above_line"), F.lit("High").alias("conf_level"))
    plan = _plan(RP.top_vulnerable_files(b, 5))
    assert "WindowGroupLimit" in plan
