"""Reply parser: hand-written cases for the column form and the UDTF; literals;
render -> parse round trip."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import fixed as FX
from parley.functions import literals as L
from parley.operators import dialogue as D
from parley.operators.udtf import parse_reply_rows

A, B = "Speaker 1", "Speaker 2"
# reply -> (speaker, text) of its segments
CASES = {
    "header": ('Sure! Here it is:\n[\n("Speaker 1", "Hi."),\n("Speaker 2", "Hello.")\n]', [(A, "Hi."), (B, "Hello.")]),
    "last without comma": ('("Speaker 1", "a"),\n("Speaker 2", "b")', [(A, "a"), (B, "b")]),
    "escapes": ('("Speaker 1", "say \\"hi\\" \\\\ ok\\nnext"),', [(A, 'say "hi" \\ ok\nnext')]),
    "first line behind a bracket is no candidate": ('[("Speaker 1", "a"),\n("Speaker 2", "b")]', []),
    "single quotes and a comma are no candidate": ("(\"Speaker 1\", 'a'),\n(\"Speaker 2\", \"b\"),", [(B, "b")]),
    "single quotes": ("(\"Speaker 1\", 'a \"b\" \\'c\\'')", [(A, "a \"b\" 'c'")]),
    "two on a line": ('("Speaker 1", "a"), ("Speaker 2", "b"),\n("Speaker 1", "c")', [(A, "a"), (B, "b"), (A, "c")]),
    "any label behind the first": ('("Speaker 1", "a"),("Host", \'b\')', [(A, "a"), ("Host", "b")]),
    "numbers": ('("Speaker 1", "\\u00e9\\x41\\101 \\U0001F600"),', [(A, "éAA 😀")]),
    "surrogates": ('("Speaker 1", "\\ud83d\\ude00 \\ud83d"),', [(A, "😀 \ufffd")]),
    "unknown escape stays": ('("Speaker 1", "\\q\\8"),', [(A, "\\q\\8")]),
    "escaped backslash before u": ('("Speaker 1", "\\\\u00e9"),', [(A, "\\u00e9")]),
    "neighbouring literals": ('("Speaker 1", "a" \'b\'  "c"),', [(A, "abc")]),
    "comma behind the last element": ('("Speaker 1", "a",)', [(A, "a")]),
    "blanks": ('  ("Speaker 1"\t,  "a" )  ', [(A, "a")]),
    "empty text": ('("Speaker 1", ""),', [(A, "")]),
    "bad line voids": ('("Speaker 1", "a"),\n("Speaker 2", "b"x)', []),
    "broken escape voids": ('("Speaker 1", "a"),\n("Speaker 2", "\\u12")', []),
    "named character voids": ('("Speaker 1", "\\N{DASH}"),', []),
    "open literal": ('("Speaker 1", "a)', []),
    "backslash at the end": ('("Speaker 1", "a\\"),', []),
    "three elements": ('("Speaker 1", "a", "b"),', []),
    "one element": ('("Speaker 1",)', []),
    "prefix": ('("Speaker 1", f"a"),', []),
    "triple quotes": ('("Speaker 1", """a"""),', []),
    "empty": ("", []),
    "no candidate": ("fine\nSpeaker 1: a", []),
    "blank lines": ('("Speaker 1", "a"),\n\n("Speaker 2", "b"),', [(A, "a"), (B, "b")]),
    "fenced": ('```python\n[\n("Speaker 1", "a"),\n]\n```', [(A, "a")]),
}


def test_both_parsers_on_hand_cases(spark):
    names = sorted(CASES)
    df = spark.createDataFrame([(i, CASES[n][0]) for i, n in enumerate(names)] + [(-1, None)], "episode_id long, reply string")
    got = {}
    for r in D.parse_replies(df).orderBy("episode_id", "seg_idx").collect():
        got.setdefault(r.episode_id, []).append((r.seg_idx, r.speaker, r.text))
    gate = {r.episode_id: r.accepted for r in D.parse_gate(df).collect()}
    for i, n in enumerate(names):
        want = [(k, *s) for k, s in enumerate(CASES[n][1])]
        assert got.get(i, []) == want, n
        assert parse_reply_rows(CASES[n][0]) == want, n
        assert gate[i] == bool(want), n
    assert -1 not in got and parse_reply_rows(None) == []


def test_example_of_the_format(spark):
    """The example in the rewriting instructions is read to its four turns."""
    reply = FX.REWRITE_SYSTEM_PROMPT
    rows = parse_reply_rows(reply)
    assert [s for _, s, _ in rows] == [A, B, A, B] and rows[1][2].startswith("[laughs]")
    df = spark.createDataFrame([(1, reply)], "episode_id long, reply string")
    assert sorted(tuple(r)[1:] for r in D.parse_replies(df).collect()) == rows


def test_udtf_takes_arrow_batches(spark):
    from parley.operators.udtf import register_parse_reply
    register_parse_reply(spark)
    spark.createDataFrame([(1, CASES["numbers"][0])], "k long, reply string").createOrReplaceTempView("parley_one_reply")
    df = spark.sql("SELECT k, p.* FROM parley_one_reply, LATERAL parse_reply(reply) p")
    assert "ArrowEvalPythonUDTF" in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [(1, 0, A, "éAA 😀")]


def test_plain_replies_pass_the_state_machine_by(spark):
    """Lines with the common escapes only are read by column expressions."""
    lines = ['("Speaker 1", "a \\"b\\" \\n \\\\"),', "(\"Speaker 2\", 'x')", '("Speaker 1", "\\u00e9"),']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "episode_id long, reply string")
    got = D._read_candidates(df, "episode_id", "reply").orderBy("episode_id").collect()
    assert [(r._plain, r._odd.segs is None) for r in got] == [(True, True), (False, False), (False, False)]


@settings(max_examples=300, deadline=None)
@given(st.text(), st.sampled_from("'\""))
def test_literals_of_any_text(text, quote):
    """Every way of writing a text as a literal gives it back."""
    whole = L.whole_characters(text)
    long = "".join(f"\\U{ord(c):08x}" for c in text)
    short = "".join(f"\\u{ord(c):04x}" if ord(c) < 0x10000 else "".join(f"\\u{c.encode('utf-16-be')[i:i + 2].hex()}" for i in (0, 2)) for c in text)
    plain = "".join("\\" + c if c in "\\\"'" else "\\n" if c == "\n" else "\\r" if c == "\r" else c for c in text)
    for body in (long, short, plain):
        assert L.unescaped(body) == whole
        assert L.tuples(f"({quote}{body}{quote}, {quote}{body}{quote})") == [(whole, whole)]


def test_render_parse_round_trip(spark):
    rows = [(1, 0, A, 'quote " and \\ back\nslash'), (1, 1, B, "plain"), (2, 0, B, "")]
    seg = spark.createDataFrame(rows, "episode_id long, seg_idx long, speaker string, text string")
    rendered = D.render_reply_lines(seg)
    back = sorted((r.episode_id, r.seg_idx, r.speaker, r.text) for r in D.parse_replies(rendered).collect())
    assert back == sorted(rows)


def test_literal_text_is_null_for_a_broken_escape(spark):
    df = spark.createDataFrame([("a\\u12",), ("\\x4",), ("a\\",), ("\\n\\x41",), (None,), ("",)], "s string")
    assert [r.t for r in df.select(D.literal_text(F.col("s")).alias("t")).collect()] == [None, None, None, "\nA", None, ""]
