"""The pipeline's stages, each on its own input, against brute force."""

import random

import pytest

import corpus_pipeline
from quarry.llm import queries

PASSAGE = " ".join(f"item{i}" for i in range(40))


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    rnd = random.Random(9)
    vocabulary = [f"word{i}" for i in range(500)] + ["the", "of", "and"] * 40

    def text(n):
        return "\n".join(" ".join(rnd.choice(vocabulary) for _ in range(12)) for _ in range(n))
    rows = [(i, text(20), f"s{i % 3}") for i in range(20)]
    near = rows[0][1].split("\n")
    rows += [(100, rows[1][1], "s1"), (101, "too short", "s1"), (102, None, None),
             (103, text(10) + "\n" + PASSAGE, "s0"), (104, "\n".join(near[:6]) + "\n" + text(9), "s2"),
             (105, "# $ " * 200, "s0"), (1, rows[1][1], "s1")]
    path = tmp_path_factory.mktemp("tables")
    make_docs(rows, clashing=True).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return str(path), rows


def test_stages_in_turn(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_phase_table(stage(spark, docs, path), "test-stage")
        if name != "mixing":
            assert docs.columns == columns
        kept.append(sorted(r.doc_id for r in docs.collect()))
    good = list(range(20))
    assert kept[0] == sorted([*good, 1, 100, 103, 104])
    assert kept[1] == sorted([*good, 103, 104])
    assert kept[2] == kept[1]
    assert kept[3] == sorted([*good, 104])
    assert kept[4] == kept[3]


def test_run_gives_the_mix(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path).collect()
    assert len(got) == 21
    sizes = {s: sum(r.size for r in got if r.source == s) for s in {r.source for r in got}}
    assert all(r.source_size == sizes[r.source] for r in got)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 32


def test_empty_corpus(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_line_dedup_stage_takes_few_jobs_however_long_the_copy(spark, make_docs, tmp_path):
    """Jobs and their plans are what filled the driver's memory."""
    run = "\n".join(f"line {i} of a copied passage" for i in range(300))
    rows = [(1, run + "\nend one"), (2, "head two\n" + run), (3, "three\nend one")]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, sc = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.sparkContext
    try:
        sc.setJobGroup("line-dedup-stage", "")
        got = {r.doc_id: r.text
               for r in corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup("line-dedup-stage"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {1: run + "\nend one", 2: "head two", 3: "three"}
    assert jobs < 110
