"""Results must not depend on partitioning (retries, executor loss, other
cluster sizes): run queries under different shuffle-partition counts and
compare value digests."""

import pytest

import __spark_entry__ as E
from oracle_check import digest

SMOKE = "/root/testdata/sf0.001"
NAMES = ["math_keyed_uniform", "aud_ambience", "win_timeline_dynamic", "win_timeline_jitter", "agg_mix_frames",
         "aud_master_chain", "join_overlap_intervals", "flow_clean_docs", "str_parse_reply", "set_timeline_parts"]


def _rows(spark, name):
    df = E.queries()[name](spark, SMOKE)
    cols = sorted(df.columns)
    return digest([tuple(r[c] for c in cols) for r in df.collect()])


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_any_partitioning(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = _rows(spark, name)
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = _rows(spark, name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
