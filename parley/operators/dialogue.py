"""Dialogue operators: render and parse tuple-list replies, contract checks,
speaker-labelled transcript lines.

The reply parser is column expressions over the reply's line array
(``filter`` / ``forall`` / ``posexplode``): no shuffle, and the all-or-nothing
gate is a per-row ``forall``.  Each reply is one input row, so nothing is
collected across rows.  Only replies with a line that is not a plain tuple
(single quotes, several tuples, escapes such as ``\\u00e9``) go to the state
machine of :mod:`parley.functions.literals`, in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from parley.functions import fixed as FX
from parley.functions import literals
from parley.functions import text as T

# Head of a tuple line: ("Speaker…", "   (group 1 = the speaker label)
HEAD = r'^\("(Speaker[^"\\]*)"[ \t]*,[ \t]*"'
# Escape pairs inside a double-quoted literal body.
ESCAPE_PAIR = r"\\[\s\S]"
PLAIN_ESCAPE = r"""\\[\\"'ntr]"""
FILLER_OR_REACTION = r"(?i)(^|[^\p{L}\p{N}_])(u+m+|h+m+)([^\p{L}\p{N}_]|$)|\[(laughs|sigh)\]"
DIALOGUE_LINE = r"(?s)^(Speaker [12]):[ \t]*(.*)$"
TURN_LINE = r"^Speaker \d+:"


def is_candidate(line: Column) -> Column:
    """Stripped line starts with ``("Speaker`` and ends with ``"),`` or ``)``."""
    return line.startswith(FX.CANDIDATE_PREFIX) & (
        line.endswith(FX.CANDIDATE_SUFFIX_COMMA) | line.endswith(FX.CANDIDATE_SUFFIX))


def drop_comma(line: Column) -> Column:
    """Remove the trailing comma of a ``"),`` line."""
    return F.when(line.endswith(FX.CANDIDATE_SUFFIX_COMMA),
                  F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def candidate_lines(reply: Column) -> Column:
    """Array of candidate tuple lines (stripped, trailing comma removed)."""
    stripped = F.transform(F.split(reply, "\n"), lambda l: T.py_strip(l))
    return F.transform(F.filter(stripped, is_candidate), drop_comma)


def _head(line: Column) -> Column:
    return F.regexp_extract(line, HEAD, 0)


def tuple_ok(line: Column) -> Column:
    """A candidate line is a valid ("Speaker…", "…") tuple with a
    double-quoted body whose every quote and backslash is escaped."""
    h = _head(line)
    body = F.substring(line, F.length(h) + 1, F.greatest(F.length(line) - F.length(h) - 2, F.lit(0)))
    bare = F.regexp_replace(body, ESCAPE_PAIR, "")
    return ((F.length(h) > 0) & line.endswith('")')
            & (F.length(line) >= F.length(h) + 2)
            & ~F.contains(bare, F.lit('"')) & ~F.contains(bare, F.lit("\\")))


def plain_tuple(line: Column) -> Column:
    """A valid tuple whose escapes are all among those of ``T.unescape``."""
    return tuple_ok(line) & ~F.contains(F.regexp_replace(line, PLAIN_ESCAPE, ""), F.lit("\\"))


def tuple_speaker(line: Column) -> Column:
    return F.regexp_extract(line, HEAD, 1)


def tuple_text(line: Column) -> Column:
    h = _head(line)
    return T.unescape(F.substring(line, F.length(h) + 1, F.length(line) - F.length(h) - 2))


READ = "n_ok int, segs array<struct<speaker:string,text:string>>"


def _read_lines(lines: pd.Series) -> pd.DataFrame:
    out = []
    for ls in lines:
        found = [] if ls is None else [literals.tuples(line) for line in ls]
        good = [t for t in found if t is not None]
        segs = [{"speaker": s, "text": x} for t in good for s, x in t] if ls is not None and len(good) == len(found) else None
        out.append((len(good), segs))
    return pd.DataFrame(out, columns=["n_ok", "segs"])


def read_lines(lines: Column) -> Column:
    """Candidate lines -> struct(n_ok, segs): how many are tuples, and the
    segments if all are (else null), by the state machine."""
    return pandas_udf(_read_lines, READ)(lines)


def _read_candidates(replies: DataFrame, key: str, reply: str, keep=()) -> DataFrame:
    """``_c`` candidate lines, ``_plain``, and ``_odd``: what the state machine
    makes of the lines of a reply that are not all plain."""
    c = replies.select(key, *keep, candidate_lines(F.col(reply)).alias("_c"))
    c = c.withColumn("_plain", F.forall("_c", plain_tuple))
    return c.withColumn("_odd", read_lines(F.when(~F.col("_plain"), F.col("_c"))))


def parse_replies(replies: DataFrame, key: str = "episode_id", reply: str = "reply") -> DataFrame:
    """Reply text -> ordered (speaker, text) segments.

    Candidate lines are selected as in the original loop; if any of them holds
    anything but tuples of two strings, or there is none, the whole reply yields
    nothing.  Output: key, seg_idx, speaker, text.
    """
    c = _read_candidates(replies, key, reply)
    plain = F.transform("_c", lambda line: F.struct(tuple_speaker(line).alias("speaker"), tuple_text(line).alias("text")))
    segs = F.when(F.col("_plain"), plain).otherwise(F.col("_odd.segs"))
    return (c.select(key, F.posexplode_outer(segs).alias("seg_idx", "_s")).where(F.col("_s").isNotNull())
            .select(key, "seg_idx", "_s.speaker", "_s.text"))


def parse_gate(replies: DataFrame, key: str = "episode_id", reply: str = "reply", keep=()) -> DataFrame:
    """Per reply: candidate count, valid count, accepted (all valid, >= 1);
    ``keep`` names columns to carry along."""
    c = _read_candidates(replies, key, reply, keep)
    n_ok = F.when(F.col("_plain"), F.size("_c")).otherwise(F.col("_odd.n_ok"))
    return c.select(key, *keep, F.size("_c").alias("n_candidates"), n_ok.alias("n_ok"),
                    ((F.size("_c") > 0) & (n_ok == F.size("_c"))).alias("accepted"))


def literal_text(body: Column) -> Column:
    """The text that the inside of a string literal stands for, null if an
    escape is broken: by columns, or by the state machine if it has an escape
    that ``T.unescape`` does not know."""
    odd = F.contains(F.regexp_replace(body, PLAIN_ESCAPE, ""), F.lit("\\"))

    def read(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else literals.unescaped(b))
    return F.when(odd, pandas_udf(read, "string")(F.when(odd, body))).otherwise(T.unescape(body))


def render_tuple(speaker: Column, text: Column) -> Column:
    return F.concat(F.lit('("'), speaker, F.lit('", "'), T.escape(text), F.lit('")'))


def render_replies(segments: DataFrame, key: str = "episode_id", order: str = "seg_idx") -> DataFrame:
    """Segments -> ``[("Speaker 1", "…"), …]`` text per episode (ordered)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                 render_tuple(F.col("speaker"), F.col("text")).alias("t"))))
    return segments.groupBy(key).agg(
        F.concat(F.lit("["), F.array_join(F.transform(parts, lambda s: s["t"]), FX.REPLY_JOIN),
                 F.lit("]")).alias("reply"))


def render_reply_lines(segments: DataFrame, key: str = "episode_id", order: str = "seg_idx") -> DataFrame:
    """Segments -> a reply in the requested output format: ``[``, one
    ``("Speaker N", "…"),`` line per turn, ``]``."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                 render_tuple(F.col("speaker"), F.col("text")).alias("t"))))
    lines = F.array_join(F.transform(parts, lambda s: F.concat(s["t"], F.lit(","))), "\n")
    return segments.groupBy(key).agg(F.concat(F.lit("[\n"), lines, F.lit("\n]")).alias("reply"))


def contract_violation(speaker: Column, text: Column) -> Column:
    """Speaker 1 must not use fillers or reactions; Speaker 2 may."""
    return (speaker == FX.SPEAKER_1) & text.rlike(FILLER_OR_REACTION)


def format_contract(replies: DataFrame, key: str = "episode_id", reply: str = "reply") -> DataFrame:
    """Per reply: labels outside {Speaker 1, Speaker 2}, blank lines between
    the first and last tuple, code fences."""
    lines = F.transform(F.split(F.col(reply), "\n"), lambda l: T.py_strip(l))
    d = replies.select(key, lines.alias("_l"))
    idx = F.sequence(F.lit(1), F.size("_l"))
    cand_pos = F.filter(idx, lambda i: is_candidate(F.element_at("_l", i)))
    first = F.array_min(cand_pos)
    last = F.array_max(cand_pos)
    blanks = F.size(F.filter(idx, lambda i: (i > first) & (i < last) & (F.element_at("_l", i) == "")))
    labels = F.transform(F.filter("_l", is_candidate), lambda l: tuple_speaker(l))
    bad = F.size(F.filter(labels, lambda s: ~s.isin(FX.SPEAKER_1, FX.SPEAKER_2)))
    fence = F.exists("_l", lambda l: l.startswith("```"))
    return d.select(key, bad.alias("n_bad_labels"), F.coalesce(blanks, F.lit(0)).alias("n_blank_lines"),
                    fence.alias("has_fence")).withColumn(
        "ok", (F.col("n_bad_labels") == 0) & (F.col("n_blank_lines") == 0) & ~F.col("has_fence"))


def _turns(transcripts: DataFrame, key: str, text: str) -> DataFrame:
    """``_lines`` and, in ``_at``, the places of the lines that begin a turn."""
    d = transcripts.select(key, F.split(F.col(text), "\n").alias("_lines"))
    return d.withColumn("_at", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.get("_lines", i).rlike(TURN_LINE)))


def dialogue_lines(transcripts: DataFrame, key: str = "episode_id", text: str = "text") -> DataFrame:
    """``Speaker 1: …`` / ``Speaker 2: …`` turns to rows, with the number of their
    first line; the lines up to the next label belong to the turn (blank ones
    at its end do not).  Turns with another number and lines before the first
    label are no rows; :func:`unread_lines` counts them."""
    d = _turns(transcripts, key, text)
    turns = F.zip_with("_at", F.slice("_at", 2, F.size("_at")), lambda a, b: F.struct(a.alias("line_no"), F.coalesce(b, F.size("_lines")).alias("end")))
    d = d.select(key, "_lines", F.explode(turns).alias("_t"))
    body = F.array_join(F.slice("_lines", F.col("_t.line_no") + 1, F.col("_t.end") - F.col("_t.line_no")), "\n")
    d = d.select(key, "_t.line_no", F.regexp_replace(body, r"\n\s*$", "").alias("_l")).where(F.col("_l").rlike(DIALOGUE_LINE))
    return d.select(key, "line_no", F.regexp_extract("_l", DIALOGUE_LINE, 1).alias("speaker"),
                    F.regexp_extract("_l", DIALOGUE_LINE, 2).alias("text"))


def unread_lines(transcripts: DataFrame, key: str = "episode_id", text: str = "text") -> DataFrame:
    """Per transcript: n_lines with text, n_turns (of Speaker 1 and 2), and how
    many lines with text belong to none of them (n_unread)."""
    d = _turns(transcripts, key, text)
    # Whether a line lies in a turn that is read: the label of the last turn at or before it.
    labels = F.transform("_at", lambda i: F.get("_lines", i).rlike(DIALOGUE_LINE))
    d = d.withColumn("_read", labels).withColumn("_ends", F.concat(F.slice("_at", 2, F.size("_at")), F.array(F.size("_lines"))))
    ink = lambda lines: F.size(F.filter(lines, lambda x: x.rlike(r"\S")))
    part = lambda a, b: ink(F.slice("_lines", a + 1, b - a))
    unread = F.zip_with(F.arrays_zip("_at", "_ends"), "_read", lambda t, r: F.when(r, F.lit(0)).otherwise(part(t["_at"], t["_ends"])))
    before = F.when(F.size("_at") > 0, part(F.lit(0), F.get("_at", F.lit(0)))).otherwise(ink(F.col("_lines")))
    return d.select(key, ink(F.col("_lines")).alias("n_lines"), F.size(F.filter("_read", lambda r: r)).alias("n_turns"),
                    (before + F.when(F.size("_at") > 0, F.aggregate(unread, F.lit(0), lambda a, x: a + x)).otherwise(0)).alias("n_unread"))


def fillers_by_speaker(segments: DataFrame, key: str = "episode_id") -> DataFrame:
    """Turns, fillers and reactions of each speaker (partial sums; a null
    speaker is one of its own)."""
    return segments.groupBy(key, "speaker").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(T.filler_count("text")).alias("n_fillers"),
                                                F.sum(T.literal_count("text", "[laughs]")).alias("n_laughs"), F.sum(T.literal_count("text", "[sigh]")).alias("n_sighs"))


def render_transcripts(segments: DataFrame, key: str = "episode_id", order: str = "seg_idx") -> DataFrame:
    """Segments -> ``Speaker N: text`` lines per episode."""
    parts = F.array_sort(F.collect_list(F.struct(
        F.col(order).alias("o"), F.concat(F.col("speaker"), F.lit(": "), F.col("text")).alias("t"))))
    return segments.groupBy(key).agg(F.array_join(F.transform(parts, lambda s: s["t"]), "\n").alias("text"))
