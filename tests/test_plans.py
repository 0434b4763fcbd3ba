"""Physical plans: few shuffles, narrow scans, pushed filters, no user code where expressions do."""

import re

import pytest

from quillstream.plans import QUERIES


def plan(spark, df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plain(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize(
    "name, shuffles",
    [("speech_runs", 1), ("speech_runs_merged", 1), ("waves_valid", 1), ("smooth_centered", 1), ("overlap_clip", 1), ("text_change_runs", 1), ("session_reset_ids", 1), ("retention_budget", 1), ("last_n_turns", 1),
     ("keep_newest", 1), ("valley_test", 1), ("best_per_group", 1), ("weighted_logprob", 1), ("tumbling_counts", 1), ("buckets", 0), ("html_text", 0), ("word_tokens", 0), ("chunk_grid_pad", 0), ("valid_embeddings", 0)],
)
def test_shuffles(plain, sf, name, shuffles):
    text = plan(plain, QUERIES[name](plain, sf))
    assert len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange ", text)) == shuffles
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop|SinglePartition", text)


def test_scans_are_narrow_and_filters_pushed(plain, sf):
    assert "ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>" in plan(plain, QUERIES["best_per_group"](plain, sf))
    assert "EqualTo(c_mktsegment,BUILDING)" in plan(plain, QUERIES["anti_membership"](plain, sf))
    assert "text" not in re.findall(r"ReadSchema: (\S+)", plan(plain, QUERIES["last_n_turns"](plain, sf)))[0]


def test_aggregates_combine_before_the_shuffle(plain, sf):
    for name in ("best_per_group", "weighted_logprob", "dir_rollup", "speaker_scores"):
        assert "partial_" in plan(plain, QUERIES[name](plain, sf))
