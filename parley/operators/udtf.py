"""The reply parser as a Python UDTF (``SELECT … FROM t, LATERAL parse_reply(reply)``).

Replies travel in Arrow batches; a reply is read by the state machine of
:mod:`parley.functions.literals` and validated completely before any row is
yielded.  The column form in :mod:`parley.operators.dialogue` reads plain lines
with column expressions and hands the others to the same state machine.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from parley.functions import fixed as FX
from parley.functions.literals import tuples


def _is_candidate(line: str) -> bool:
    return line.startswith(FX.CANDIDATE_PREFIX) and line.endswith((FX.CANDIDATE_SUFFIX_COMMA, FX.CANDIDATE_SUFFIX))


def parse_reply_rows(reply: str | None) -> list[tuple[int, str, str]]:
    """List of (seg_idx, speaker, text), or [] when any candidate is invalid."""
    stripped = (line.strip() for line in (reply or "").split("\n"))
    rows = []
    for line in filter(_is_candidate, stripped):
        found = tuples(line[:-1] if line.endswith(FX.CANDIDATE_SUFFIX_COMMA) else line)
        if found is None:
            return []
        rows += found
    return [(i, speaker, text) for i, (speaker, text) in enumerate(rows)]


@udtf(returnType="seg_idx int, speaker string, text string", useArrow=True)
class ParseReply:
    def eval(self, reply: str):
        yield from parse_reply_rows(reply)


def register_parse_reply(spark: SparkSession, name: str = "parse_reply") -> None:
    spark.udtf.register(name, ParseReply)
