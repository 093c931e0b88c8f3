"""Connected components take few shuffles a round; groups of the pipeline's second stage do not hang on repeated ids."""

import corpus_pipeline
from tesserae.llm.common import components


def test_stages_of_components(spark):
    sc = spark.sparkContext
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(None, 3), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    sc.setJobGroup("components", "")
    rows = components(df).collect()
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("components")]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r.node: r.root for r in rows} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    ran = sum(i.numCompletedTasks > 0 for j in jobs for s in j.stageIds if (i := sc.statusTracker().getStageInfo(s)))
    assert ran <= 4 * 8, ran  # of at most eight rounds; six shuffles and a count each took more


def test_repeated_ids_do_not_join_groups(spark, tmp_path):
    """Two texts with one doc_id lie in different groups, and their copies with them: one row of each group stays."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "vw")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, a), (1, b)]
