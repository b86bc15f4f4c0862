"""Queries over dialogue replies and segments (flow B steps 3-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import dialogue as D
from parley.operators.scan import Linked
from parley.plans.fixture_sql import WS_CHARS_SQL, escape, unescape
from parley.plans.q_requests import TRANSCRIPTS_CTE, transcripts
from parley.plans.registry import query
from parley.sources import fixtures as FX

# ---- SQL mirror of the parser (RE2 patterns, DuckDB list functions)
_HEAD = r'''^\("(Speaker[^"\\]*)"[ \t]*,[ \t]*"'''


def _cand(l: str) -> str:
    return f"""(starts_with({l}, '("Speaker') AND (ends_with({l}, '"),') OR ends_with({l}, ')')))"""


def _drop_comma(l: str) -> str:
    return f"""CASE WHEN ends_with({l}, '"),') THEN substring({l}, 1, length({l}) - 1) ELSE {l} END"""


def _ok(l: str) -> str:
    h = f"regexp_extract({l}, '{_HEAD}', 0)"
    body = f"substring({l}, length({h}) + 1, greatest(length({l}) - length({h}) - 2, 0))"
    bare = f"regexp_replace({body}, '\\\\[\\s\\S]', '', 'g')"
    return (f"(length({h}) > 0 AND ends_with({l}, '\")') AND length({l}) >= length({h}) + 2 "
            f"AND NOT contains({bare}, '\"') AND NOT contains({bare}, '\\'))")


def _text(l: str) -> str:
    h = f"regexp_extract({l}, '{_HEAD}', 0)"
    return unescape(f"substring({l}, length({h}) + 1, length({l}) - length({h}) - 2)")


_LINES = f"list_transform(string_split(reply, chr(10)), lambda l: trim(l, {WS_CHARS_SQL}))"
_CANDS = f"list_transform(list_filter({_LINES}, lambda l: {_cand('l')}), lambda l: {_drop_comma('l')})"
CANDIDATES_CTE = {"q_cands": f"SELECT episode_id, {_CANDS} AS c FROM f_replies"}


@query("flt_candidate_lines", f"""
    SELECT episode_id, k AS line_no, l AS line FROM (
        SELECT episode_id, k, {_drop_comma('ls[k + 1]')} AS l, {_cand('ls[k + 1]')} AS cand
        FROM (SELECT episode_id, ls, unnest(range(len(ls))) AS k
              FROM (SELECT episode_id, {_LINES} AS ls FROM f_replies)))
    WHERE cand""")
def flt_candidate_lines(spark, sf_dir):
    """Candidate tuple lines of each reply with their line number."""
    r = FX.replies(spark, sf_dir)
    lines = r.select("episode_id", F.posexplode_outer(F.split("reply", "\n")).alias("line_no", "l"))
    s = lines.select("episode_id", "line_no", T.py_strip("l").alias("l"))
    return s.where(D.is_candidate(F.col("l"))).select("episode_id", "line_no", D.drop_comma(F.col("l")).alias("line"))


@query("str_parse_reply", f"""
    SELECT episode_id, k AS seg_idx, regexp_extract(c[k + 1], '{_HEAD}', 1) AS speaker, {_text('c[k + 1]')} AS text
    FROM (SELECT episode_id, c, unnest(range(len(c))) AS k FROM q_cands
          WHERE len(c) > 0 AND len(list_filter(c, lambda l: NOT {_ok('l')})) = 0)""", CANDIDATES_CTE)
def str_parse_reply(spark, sf_dir):
    """Replies -> segments with the all-or-nothing gate; equals the segment
    fixture for every episode that is not voided."""
    return D.parse_replies(FX.replies(spark, sf_dir))


@query("agg_parse_gate", f"""
    SELECT episode_id, len(c) AS n_candidates, len(list_filter(c, lambda l: {_ok('l')})) AS n_ok,
           len(c) > 0 AND len(list_filter(c, lambda l: {_ok('l')})) = len(c) AS accepted
    FROM q_cands""", CANDIDATES_CTE)
def agg_parse_gate(spark, sf_dir):
    return D.parse_gate(FX.replies(spark, sf_dir))


# Inside of a literal and the text it stands for, by ``seg_idx % 8`` (behind the escaped text of the segment).
_ESCAPES = [(r"\u00e9\x41", "éA"), (r"\ud83d\ude00!", "😀!"), (r"\101\60\0608", "A0" + "08"), (r"\t\'\q\v", "\t'\\q\x0b"),
            (r"\U0001F600\\u00e9", "😀\\u00e9"), (r"\ud83d\n\xe9", "\ufffd\né"), (r"\u12", None), ("", "")]


def _sql_text(s: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if s is None else " || ".join([f"chr({ord(ch)})" for ch in s] or ["''"])


@query("str_unescape", f"""
    SELECT episode_id, seg_idx, text || CASE seg_idx % 8 {' '.join(f'WHEN {k} THEN {_sql_text(t)}' for k, (_, t) in enumerate(_ESCAPES))} END AS text
    FROM f_segments""")
def str_unescape(spark, sf_dir):
    """Insides of string literals to text: the escaped segment and, behind it,
    escapes of every kind, by hex, Unicode and octal number, surrogate pairs, unknown
    and broken ones (which give null)."""
    s = FX.segments(spark, sf_dir)
    more = F.element_at(F.array(*[F.lit(e) for e, _ in _ESCAPES]), (F.col("seg_idx") % 8 + 1).cast("int"))
    return s.select("episode_id", "seg_idx", D.literal_text(F.concat(T.escape("text"), more)).alias("text"))


@query("str_parse_literals", """
    SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY seg_idx, half) - 1 AS seg_idx,
           CASE WHEN half = 1 THEN 'Narrator' ELSE speaker END AS speaker,
           CASE WHEN half = 1 THEN 'é' WHEN seg_idx % 3 = 1 THEN replace(text, chr(39), chr(34)) || chr(233) ELSE text END AS text
    FROM f_segments, (VALUES (0), (1)) h(half) WHERE episode_id % 7 <> 3 AND (half = 0 OR seg_idx % 3 = 2)""")
def str_parse_literals(spark, sf_dir):
    """Replies that need the state machine: single quotes and numeric escapes
    (seg_idx % 3 = 1), a second tuple on the line (2); a broken escape in turn 0 of
    every episode with ``episode_id % 7 = 3`` voids its reply."""
    s, i = FX.segments(spark, sf_dir), F.col("seg_idx") % 3
    body = T.escape("text")
    single = F.concat(F.replace(F.replace(body, F.lit("'"), F.lit('\\"')), F.lit('\\"'), F.lit('"')), F.lit("\\xe9"))
    line = (F.when(i == 1, F.concat(F.lit('("'), F.col("speaker"), F.lit("\", '"), single, F.lit("')")))
            .otherwise(F.concat(F.lit('("'), F.col("speaker"), F.lit('", "'), body, F.lit('")'), F.when(i == 2, F.lit(", ('Narrator', '\\u00e9',)")).otherwise(F.lit("")))))
    broken = (F.col("episode_id") % 7 == 3) & (F.col("seg_idx") == 0)
    line = F.when(broken, F.lit('("Speaker 1", "\\u12")')).otherwise(line)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("l")))), lambda x: x["l"]), "\n")
    return D.parse_replies(s.groupBy("episode_id").agg(lines.alias("reply")))


@query("agg_segments_to_reply", f"""
    SELECT episode_id,
           '[' || string_agg('("' || speaker || '", "' || {escape('text')} || '")', ', ' ORDER BY seg_idx) || ']'
               AS reply
    FROM f_segments GROUP BY episode_id""")
def agg_segments_to_reply(spark, sf_dir):
    return D.render_replies(FX.segments(spark, sf_dir))


@query("map_segment_struct", """
    SELECT episode_id, count(*) AS n_segments,
           arg_min(speaker, seg_idx) AS first_speaker, arg_max(speaker, seg_idx) AS last_speaker,
           arg_max(text, seg_idx) AS last_text
    FROM f_segments GROUP BY episode_id""")
def map_segment_struct(spark, sf_dir):
    """First and last segment of an episode as ``struct<speaker,text>``,
    accessed by field name (no episode is gathered)."""
    s = FX.segments(spark, sf_dir)
    seg = F.struct("speaker", "text")
    ends = s.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_segments"), F.min_by(seg, "seg_idx").alias("first"), F.max_by(seg, "seg_idx").alias("last"))
    return ends.select("episode_id", "n_segments", F.col("first.speaker").alias("first_speaker"), F.col("last.speaker").alias("last_speaker"),
                       F.col("last.text").alias("last_text"))


# Segments with injected fillers / reactions: Speaker texts with seg_idx % 4 = 1
# start with "Hmm, [laughs] ", those with seg_idx % 4 = 3 start with "umm... ".
_MARKED_SEG_SQL = """
    SELECT episode_id, seg_idx, speaker,
           CASE seg_idx % 4 WHEN 1 THEN 'Hmm, [laughs] ' || text WHEN 3 THEN 'umm... ' || text ELSE text END AS text
    FROM f_segments"""


def _marked_segments(spark, sf_dir):
    s = FX.segments(spark, sf_dir)
    t = (F.when(F.col("seg_idx") % 4 == 1, F.concat(F.lit("Hmm, [laughs] "), F.col("text")))
         .when(F.col("seg_idx") % 4 == 3, F.concat(F.lit("umm... "), F.col("text"))).otherwise(F.col("text")))
    return s.withColumn("text", t)


_FILLER_RE = r"(?i)(^|[^\p{L}\p{N}_])(u+m+|h+m+)([^\p{L}\p{N}_]|$)|\[(laughs|sigh)\]"


@query("flt_speaker_contract", f"""
    SELECT episode_id, seg_idx, speaker FROM ({_MARKED_SEG_SQL})
    WHERE speaker = 'Speaker 1' AND regexp_matches(text, '{_FILLER_RE}')""")
def flt_speaker_contract(spark, sf_dir):
    """Violations: Speaker 1 turns that use fillers or reactions."""
    s = _marked_segments(spark, sf_dir)
    return s.where(D.contract_violation(F.col("speaker"), F.col("text"))).select("episode_id", "seg_idx", "speaker")


_FMT_LINES = f"list_transform(string_split(reply, chr(10)), lambda l: trim(l, {WS_CHARS_SQL}))"


@query("flt_format_contract", f"""
    SELECT episode_id, n_bad_labels, n_blank_lines, has_fence,
           n_bad_labels = 0 AND n_blank_lines = 0 AND NOT has_fence AS ok
    FROM (
      SELECT episode_id,
             len(list_filter(list_filter(ls, lambda l: {_cand('l')}),
                 lambda l: regexp_extract(l, '{_HEAD}', 1) NOT IN ('Speaker 1', 'Speaker 2'))) AS n_bad_labels,
             coalesce(len(list_filter(range(1, len(ls) + 1),
                 lambda i: i > list_min(cp) AND i < list_max(cp) AND ls[i] = '')), 0) AS n_blank_lines,
             len(list_filter(ls, lambda l: starts_with(l, '```'))) > 0 AS has_fence
      FROM (SELECT episode_id, ls, list_filter(range(1, len(ls) + 1), lambda i: {_cand('ls[i]')}) AS cp
            FROM (SELECT episode_id, {_FMT_LINES} AS ls FROM q_fmt_replies)))""",
       {"q_fmt_replies": f"""
    SELECT episode_id,
           CASE episode_id % 5 WHEN 1 THEN replace(reply, '"),' || chr(10), '"),' || chr(10) || chr(10))
                               WHEN 2 THEN '```python' || chr(10) || reply || chr(10) || '```'
                               ELSE reply END AS reply
    FROM f_replies"""})
def flt_format_contract(spark, sf_dir):
    """Format rules per reply: labels, blank lines between tuples, code
    fences.  Episodes with id % 5 = 1 get blank lines, % 5 = 2 a fence."""
    r = FX.replies(spark, sf_dir)
    rep = (F.when(F.col("episode_id") % 5 == 1, F.replace("reply", F.lit('"),\n'), F.lit('"),\n\n')))
           .when(F.col("episode_id") % 5 == 2, F.concat(F.lit("```python\n"), F.col("reply"), F.lit("\n```")))
           .otherwise(F.col("reply")))
    return D.format_contract(r.withColumn("reply", rep))


_TURNS_SQL = """
    WITH q_marked_transcripts AS (
        SELECT episode_id, 'Title of ' || episode_id || chr(10) || chr(10)
               || string_agg(speaker || ': ' || text || CASE seg_idx % 3 WHEN 1 THEN chr(10) || 'and so on,' || chr(10) || chr(10) || 'Speaker 9' WHEN 2 THEN chr(10) || '  ' ELSE '' END,
                             chr(10) ORDER BY seg_idx) AS text
        FROM f_segments GROUP BY episode_id),
    l AS (SELECT episode_id, k, ls[k + 1] AS l FROM (SELECT episode_id, ls, unnest(range(len(ls))) AS k FROM (SELECT episode_id, string_split(text, chr(10)) AS ls FROM q_marked_transcripts))),
    t AS (SELECT *, sum(CASE WHEN regexp_matches(l, '^Speaker \\d+:') THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY k) AS turn FROM l),
    g AS (SELECT episode_id, turn, min(k) AS line_no, regexp_replace(string_agg(l, chr(10) ORDER BY k), '\\n\\s*$', '') AS body,
                 count_if(regexp_matches(l, '\\S')) AS n FROM t GROUP BY ALL),
    r AS (SELECT *, turn > 0 AND regexp_matches(body, '^Speaker [12]:') AS read FROM g)"""


def _marked_transcripts(spark, sf_dir):
    """Transcripts with a title; some turns go on over lines."""
    s, k = FX.segments(spark, sf_dir), F.col("seg_idx") % 3
    more = F.when(k == 1, F.lit("\nand so on,\n\nSpeaker 9")).when(k == 2, F.lit("\n  ")).otherwise(F.lit(""))
    t = D.render_transcripts(s.withColumn("text", F.concat("text", more)))
    return t.select("episode_id", F.concat(F.lit("Title of "), F.col("episode_id").cast("string"), F.lit("\n\n"), F.col("text")).alias("text"))


@query("flt_dialogue_lines", _TURNS_SQL + """
    SELECT episode_id, line_no, regexp_extract(body, '(?s)^(Speaker [12]):[ \\t]*(.*)$', 1) AS speaker,
           regexp_extract(body, '(?s)^(Speaker [12]):[ \\t]*(.*)$', 2) AS text
    FROM r WHERE read""")
def flt_dialogue_lines(spark, sf_dir):
    """``Speaker N: text`` turns to rows, the lines that continue a turn joined
    to it (Speaker 3 turns and the title are not read)."""
    return D.dialogue_lines(_marked_transcripts(spark, sf_dir))


@query("flt_unread_lines", _TURNS_SQL + """
    SELECT episode_id, CAST(sum(n) AS BIGINT) AS n_lines, count_if(read)::BIGINT AS n_turns, CAST(sum(CASE WHEN read THEN 0 ELSE n END) AS BIGINT) AS n_unread
    FROM r GROUP BY episode_id""")
def flt_unread_lines(spark, sf_dir):
    """Lines of each transcript that are in no turn of Speaker 1 or 2, counted."""
    return D.unread_lines(_marked_transcripts(spark, sf_dir))


@query("win_speaker_runs", """
    SELECT episode_id, seg_idx, speaker, coalesce(prev = speaker, false) AS is_repeat,
           CAST(sum(CASE WHEN coalesce(prev = speaker, false) THEN 0 ELSE 1 END)
               OVER (PARTITION BY episode_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               - 1 AS BIGINT) AS run_id
    FROM (SELECT *, lag(speaker) OVER (PARTITION BY episode_id ORDER BY seg_idx) AS prev
          FROM (SELECT episode_id, seg_idx, CASE WHEN speaker = 'Speaker 1' THEN speaker ELSE 'Speaker 2' END AS speaker
                FROM f_segments))""")
def win_speaker_runs(spark, sf_dir):
    """Back-and-forth check: a turn repeats when the previous speaker is the
    same (non-Speaker-1 labels count as Speaker 2); run ids count changes."""
    s = FX.segments(spark, sf_dir).select(
        "episode_id", "seg_idx",
        F.when(F.col("speaker") == "Speaker 1", F.col("speaker")).otherwise(F.lit("Speaker 2")).alias("speaker"))
    repeat = lambda prev, speaker: F.coalesce(prev == speaker, F.lit(False))
    change = lambda prev, of: F.when(repeat(prev, of("speaker")), 0).otherwise(1).cast("long")
    s = Linked("episode_id", "seg_idx", F.col("speaker"), {"_changes": change}, ["speaker"]).scan(s, "_prev")
    return s.select("episode_id", "seg_idx", "speaker", repeat(F.col("_prev"), F.col("speaker")).alias("is_repeat"),
                    (F.col("_changes") - 1).alias("run_id"))


@query("udtf_parse_reply", f"""
    SELECT episode_id, k AS seg_idx, regexp_extract(c[k + 1], '{_HEAD}', 1) AS speaker, {_text('c[k + 1]')} AS text
    FROM (SELECT episode_id, c, unnest(range(len(c))) AS k FROM q_cands
          WHERE len(c) > 0 AND len(list_filter(c, lambda l: NOT {_ok('l')})) = 0)""", CANDIDATES_CTE)
def udtf_parse_reply(spark, sf_dir):
    """The reply parser as a Python table function used with LATERAL; it
    validates every line before yielding, so it gates like the column form."""
    import uuid
    from parley.operators.udtf import register_parse_reply
    register_parse_reply(spark)
    view = f"parley_replies_{uuid.uuid4().hex}"
    FX.replies(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(f"SELECT r.episode_id, p.seg_idx, p.speaker, p.text "
                     f"FROM {view} r, LATERAL parse_reply(r.reply) p")
