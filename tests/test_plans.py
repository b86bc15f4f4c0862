"""Physical-plan guards: no cartesian products or nested-loop joins, narrow
operators add no shuffle, scans read only the columns they use."""

import re

import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"
NARROW = ["str_word_chunks", "str_strip_latex", "str_fix_whitespace", "str_strip_citations", "str_speech_text",
          "str_drop_commentary", "str_clean_rules", "str_filler_counts", "str_unicode_words", "req_clean",
          "req_transcript", "json_request_payload", "str_prompt_render", "aud_quantise", "aud_gain", "agg_peak",
          "aud_normalise", "aud_low_pass", "aud_high_pass", "aud_compress", "aud_resample", "arr_second_slices",
          "math_clip", "src_frames", "src_pages", "flt_nonempty", "aud_segment_chain"]


def plan(spark, name):
    df = E.queries()[name](spark, SMOKE)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in E.queries() if not n.startswith("stream_")))
def test_no_cartesian(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


@pytest.mark.parametrize("name", NARROW)
def test_narrow_queries_do_not_shuffle(spark, name):
    p = plan(spark, name)
    exchanges = re.findall(r"Exchange (\w+)\(?.*?(REPARTITION_BY_NUM|ENSURE_REQUIREMENTS)", p)
    # the only exchange allowed is the spread of a single-split input file
    assert all(kind == "REPARTITION_BY_NUM" for _, kind in exchanges), (name, exchanges)
    assert len(exchanges) <= 1, (name, exchanges)


def test_scans_are_pruned(spark):
    p = plan(spark, "str_word_chunks")
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert schemas and all("lang" not in s and "n_chars" not in s for s in schemas), schemas


@pytest.mark.parametrize("name", ["win_timeline_dynamic", "win_timeline_plain", "win_timeline_jitter",
                                  "win_char_offset", "win_prev_speaker", "win_pacing", "win_position",
                                  "win_speaker_runs", "set_timeline_parts", "flt_char_cap"])
def test_row_windows_are_blocked(spark, name):
    """Windows over the row index are partitioned by (key, block), never by
    the key alone, so one huge episode or document is split across tasks."""
    p = re.sub(r"#\d+L?", "", plan(spark, name))
    specs = re.findall(r"windowspecdefinition\(([^)]*?)(?:, specifiedwindowframe|\))", p)
    row_level = [s for s in specs if re.search(r"\b(seg_idx|page_no|chunk_idx|t|i) ASC", s)]
    assert row_level, (name, specs)
    assert all("_scan_block" in s or "_blk" in s for s in row_level), (name, row_level)


def test_spread_only_when_few_splits(spark):
    from parley.sources.files import spread
    many = spark.range(0, 1000, numPartitions=spark.sparkContext.defaultParallelism * 3)
    assert spread(many, ["id"]) is many                  # enough splits: unchanged, no shuffle
    few = spark.range(0, 1000, numPartitions=1)
    spread_few = spread(few, ["id"])
    assert spread_few.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in spread_few.collect()) == list(range(1000))


# Shuffles of the final plan, the spread of the single-split input (one for each scan) left out: the rows,
# the block summaries on their way to the key and back; the sweep deals its intervals once more, the plan gathers its replies.
@pytest.mark.parametrize("name,most", [("win_timeline_dynamic", 3), ("win_speaker_runs", 3), ("agg_episode_duration", 2), ("flow_episode_plan", 3),
                                       ("join_overlap_intervals", 4)])
def test_composite_scans_shuffle_little(spark, name, most):
    df = E.queries()[name](spark, SMOKE)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    stages = len(re.findall(r"\bShuffleQueryStage\b", final)) - len(re.findall(r"Exchange .*REPARTITION_BY_NUM", final))
    assert stages <= most, (name, stages)
    if name not in ("agg_episode_duration", "flow_episode_plan"):   # their rows are needed for the summaries only
        assert "ReusedExchange" in final, name


def test_timelines_share_a_shuffle_with_columns_that_travel(spark):
    """Without broadcasts and with a column that only travels: four shuffles."""
    from parley.operators import episode as EP
    s = spark.range(1000).selectExpr("id div 100 as episode_id", "id % 100 as seg_idx", "'Speaker 1' as speaker", "id + 900 as dur_ms", "true as ok",
                                     "repeat('x', 10) as text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = EP.timeline_dynamic(s)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"Exchange hashpartitioning", p)) <= 4
