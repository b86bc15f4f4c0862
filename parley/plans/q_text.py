"""Queries over document text: pages, cap, chunks, cleanup, re-assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import dialogue as D
from parley.operators import text as X
from parley.plans.fixture_sql import NL, strip, words
from parley.plans.registry import query
from parley.sources import fixtures as FX

CAP_CHARS = 4000        # cap used by flt_char_cap so that truncation occurs at sf0.01


@query("src_pages", "SELECT doc_id, page_no, page_text FROM f_pages")
def src_pages(spark, sf_dir):
    return FX.pages(spark, sf_dir)


@query("win_char_offset", """
    SELECT doc_id, page_no,
           CAST(coalesce(sum(length(page_text) + 1) OVER (PARTITION BY doc_id ORDER BY page_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char
    FROM f_pages""")
def win_char_offset(spark, sf_dir):
    return X.char_offsets(FX.pages(spark, sf_dir)).select("doc_id", "page_no", "start_char")


@query("flt_char_cap", f"""
    WITH o AS (
        SELECT doc_id, page_no, page_text,
               coalesce(sum(length(page_text) + 1) OVER (PARTITION BY doc_id ORDER BY page_no
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char
        FROM f_pages)
    SELECT doc_id, substring(string_agg(page_text || chr(10), '' ORDER BY page_no), 1, {CAP_CHARS}) AS text,
           CAST(least(max(start_char + length(page_text) + 1), {CAP_CHARS}) AS BIGINT) AS n_chars,
           max(start_char + length(page_text) + 1) > {CAP_CHARS} AS truncated
    FROM o WHERE start_char <= {CAP_CHARS} GROUP BY doc_id""")
def flt_char_cap(spark, sf_dir):
    return X.cap_document(FX.pages(spark, sf_dir), max_chars=CAP_CHARS)


@query("agg_pages_to_doc", """
    SELECT doc_id, string_agg(page_text || chr(10), '' ORDER BY page_no) AS text FROM f_pages GROUP BY doc_id""")
def agg_pages_to_doc(spark, sf_dir):
    return X.pages_to_doc(FX.pages(spark, sf_dir))


@query("str_word_chunks", "SELECT doc_id, chunk_idx, n_words, text FROM f_chunks")
def str_word_chunks(spark, sf_dir):
    return FX.chunks(spark, sf_dir)


_SEP_SQL = "CASE doc_id % 3 WHEN 0 THEN chr(160) WHEN 1 THEN chr(12288) ELSE chr(28) END"


@query("str_unicode_words", f"""
    SELECT doc_id, len({words(f"replace(text, ' ', {_SEP_SQL})")}) AS n_words,
           len({words('text')}) AS n_words_plain
    FROM documents""")
def str_unicode_words(spark, sf_dir):
    """Word counts after replacing every space by NBSP, U+3000 or U+001C:
    Python-whitespace splitting must give the plain count."""
    d = FX.documents(spark, sf_dir)
    sep = F.element_at(F.array(F.lit("\u00a0"), F.lit("\u3000"), F.lit("\u001c")),
                       (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select("doc_id", T.word_count(F.replace(F.col("text"), F.lit(" "), sep)).alias("n_words"),
                    T.word_count("text").alias("n_words_plain"))


_LATEX_SQL = (r"regexp_replace(regexp_replace(text, '\$[^$\n]+\$', '', 'g'), "
              r"'\\[a-zA-Z]+(\{[^}]*\})?', '', 'g')")


@query("str_strip_latex", f"SELECT doc_id, {_LATEX_SQL} AS text FROM f_marked")
def str_strip_latex(spark, sf_dir):
    return FX.marked(spark, sf_dir).select("doc_id", T.strip_latex("text").alias("text"))


_WS_SQL = strip(r"regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query("str_fix_whitespace", f"SELECT doc_id, {_WS_SQL} AS text FROM f_marked")
def str_fix_whitespace(spark, sf_dir):
    return FX.marked(spark, sf_dir).select("doc_id", T.fix_whitespace("text").alias("text"))


_CITE_SQL = (r"regexp_replace(regexp_replace(regexp_replace(text, '(?s)\n(References|REFERENCES)\n.*', '', 'g'), "
             r"'\[\d+(,[ \t]*\d+)*\]', '', 'g'), '\([A-Z][a-z]+( et al\.)?,? \d{4}\)', '', 'g')")


@query("str_strip_citations", f"SELECT doc_id, {_CITE_SQL} AS text FROM f_marked")
def str_strip_citations(spark, sf_dir):
    return FX.marked(spark, sf_dir).select("doc_id", T.strip_citations("text").alias("text"))


_SPEECH_SQL = (r"regexp_replace(regexp_replace(text, '\n[ \t]*(•|\d+\.)[ \t]+', chr(10), 'g'), "
               r"'^[ \t]*(•|\d+\.)[ \t]+', '')")


@query("str_speech_text", f"""
    SELECT doc_id, {_SPEECH_SQL} AS text, len({words('text')}) AS words_before,
           len({words(_SPEECH_SQL)}) AS words_after
    FROM f_marked""")
def str_speech_text(spark, sf_dir):
    d = FX.marked(spark, sf_dir)
    return d.select("doc_id", T.speech_text("text").alias("text"),
                    T.word_count("text").alias("words_before"),
                    T.word_count(T.speech_text("text")).alias("words_after"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# Broken lines behind the text of each document, by ``doc_id % 6``.
_BROKEN = ["\n\nThe hub is certi-\nfied for outdoor\nuse, as a well-known\nhouse writes. A well-\nknown one.",
           "\n\nKey Details\nThe device runs on\na system.\n• one item that\n  goes on\n• two",
           "\n\nDisplay: colour touch screen of the first kind\nMemory: large\nSensors,\nGyroscope",
           "\n\nThis line is longer than forty characters and\nGoes on. It ends.\nNew one",
           "\n1. first\n2) second\nthird \t\r\n\n\n  indented\n  again",
           "\n\nfür die Über-\nführung und die Über-\nFührung\n"]
_JOIN_SQL = f"""
    WITH b AS (
        SELECT doc_id, text || CASE doc_id % 6 {' '.join(f'WHEN {k} THEN ' + ' || chr(10) || '.join(_sql(p) for p in t.split(chr(10))) for k, t in enumerate(_BROKEN))} END AS text
        FROM documents),
    l AS (SELECT *, string_split(text, chr(10)) AS ls FROM b),
    e AS (SELECT doc_id, text, ls, k, ls[k] AS raw, regexp_replace(ls[k], {_sql(T.LINE_TAIL)}, '') AS t FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM l)),
    kinds AS (
        SELECT *, NOT regexp_matches(raw, {_sql(T.INK)}) AS blank, regexp_matches(t, {_sql(T.LIST_ITEM)}) AS item, regexp_matches(t, {_sql(T.LABEL_START)}) AS label,
               (k = 1 OR NOT regexp_matches(ls[k - 1], {_sql(T.INK)})) AND len(regexp_split_to_array(trim(t), '[ \\t]+')) <= 8
               AND regexp_matches(t, {_sql(T.TITLE_START)}) AND NOT regexp_matches(t, {_sql(T.SENTENCE_END)}) AND NOT regexp_matches(t, {_sql(T.TITLE_STOP)})
               AND NOT regexp_matches(t, {_sql(T.LIST_ITEM)}) AND NOT coalesce(regexp_matches(ls[k + 1], {_sql(T.LOWER_START)}), false) AS heading
        FROM e),
    pair AS (
        SELECT *, lead(t) OVER w AS nt, lead(blank) OVER w AS nblank, lead(item) OVER w AS nitem, lead(label) OVER w AS nlabel, lead(heading) OVER w AS nheading,
               regexp_extract(t, {_sql(T.CUT_HEAD)}, 1) AS head, regexp_extract(coalesce(lead(t) OVER w, ''), {_sql(T.CUT_TAIL)}, 1) AS tail
        FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    j AS (
        SELECT *, CASE WHEN nt IS NULL THEN 'end' WHEN blank OR heading OR nblank OR nitem OR nheading THEN 'line'
                       WHEN head <> '' AND tail <> '' THEN CASE WHEN list_contains(regexp_extract_all(text, {_sql(T.HYPHENATED)}), head || '-' || tail) THEN 'hyphen' ELSE 'word' END
                       WHEN (regexp_matches(nt, {_sql(T.LOWER_START)}) OR ends_with(t, ',') OR (length(t) >= 40 AND NOT nlabel))
                            AND NOT regexp_matches(t, {_sql(T.SENTENCE_END)}) THEN 'space' ELSE 'line' END AS joint FROM pair),
    p AS (
        SELECT *, CASE WHEN coalesce(lag(joint) OVER (PARTITION BY doc_id ORDER BY k), 'line') = 'line' THEN t ELSE regexp_replace(t, '^[ \\t]+', '') END AS own FROM j),
    o AS (
        SELECT doc_id, any_value(text) AS before,
               string_agg(CASE joint WHEN 'line' THEN own || chr(10) WHEN 'space' THEN own || ' ' WHEN 'word' THEN regexp_replace(own, {_sql(T.HYPHEN)}, '')
                               WHEN 'hyphen' THEN regexp_replace(own, {_sql(T.HYPHEN)}, '') || '-' ELSE own END, '' ORDER BY k) AS text,
               count(*) AS n_lines_before, CAST(count_if(joint IN ('line', 'end')) AS BIGINT) AS n_lines_after
        FROM p GROUP BY doc_id)
    SELECT doc_id, text, n_lines_before, n_lines_after, len({words('before')}) AS words_before, len({words('text')}) AS words_after FROM o"""


@query("str_join_lines", _JOIN_SQL)
def str_join_lines(spark, sf_dir):
    """Line joins: broken sentences, words and list items joined, headings,
    labels and blank lines kept apart, with the words retained."""
    broken = F.element_at(F.array(*[F.lit(b) for b in _BROKEN]), (F.col("doc_id") % 6 + 1).cast("int"))
    return X.join_lines(FX.documents(spark, sf_dir).select("doc_id", F.concat("text", broken).alias("text")))


_COMMENT_RE = r"(?is)^[ \t]*((here('s| is) (the )?cleaned text[^:]{0,60}|sure[^a-z0-9:][^:]{0,60}):|sure[!.,]?)[ \t]*$".replace("'", "''")


@query("str_drop_commentary", f"""
    SELECT doc_id,
           array_to_string(list_filter(string_split(text, {NL}), lambda l: NOT regexp_matches(l, '{_COMMENT_RE}')),
                           {NL}) AS text,
           len(list_filter(string_split(text, {NL}), lambda l: regexp_matches(l, '{_COMMENT_RE}'))) AS n_removed
    FROM f_marked""")
def str_drop_commentary(spark, sf_dir):
    d = FX.marked(spark, sf_dir)
    return d.select("doc_id", T.drop_commentary("text").alias("text"),
                    T.commentary_lines("text").alias("n_removed"))


@query("str_clean_rules", f"""
    SELECT doc_id, len({words('text')}) AS words_before,
           {strip(r"regexp_replace(regexp_replace(t4, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")}
               AS text
    FROM (SELECT doc_id, text,
                 array_to_string(list_filter(string_split(
                     regexp_replace(regexp_replace(t2, '\\n[ \\t]*(•|\\d+\\.)[ \\t]+', chr(10), 'g'),
                                    '^[ \\t]*(•|\\d+\\.)[ \\t]+', ''), {NL}),
                     lambda l: NOT regexp_matches(l, '{_COMMENT_RE}')), {NL}) AS t4
          FROM (SELECT doc_id, text, {_CITE_SQL.replace("(text,", "(t1,", 1)} AS t2
                FROM (SELECT doc_id, text, {_LATEX_SQL} AS t1 FROM f_marked)))""")
def str_clean_rules(spark, sf_dir):
    """All cleanup rules in order (LaTeX, citations, list markers,
    commentary, whitespace)."""
    d = FX.marked(spark, sf_dir)
    return d.select("doc_id", T.word_count("text").alias("words_before"), T.clean_text("text").alias("text"))


_TOKENS_SQL = r"regexp_split_to_array(text, '[^\p{L}\p{N}_]+')"


@query("str_filler_counts", f"""
    SELECT doc_id,
           len(list_filter({_TOKENS_SQL}, lambda t: regexp_matches(t, '(?i)^(u+m+|h+m+)$'))) AS n_fillers,
           CAST((length(text) - length(replace(text, '[laughs]', ''))) / 8 AS BIGINT) AS n_laughs,
           CAST((length(text) - length(replace(text, '[sigh]', ''))) / 6 AS BIGINT) AS n_sighs
    FROM f_marked""")
def str_filler_counts(spark, sf_dir):
    d = FX.marked(spark, sf_dir)
    return d.select("doc_id", T.filler_count("text").alias("n_fillers"),
                    T.literal_count("text", "[laughs]").alias("n_laughs"),
                    T.literal_count("text", "[sigh]").alias("n_sighs"))


@query("agg_filler_by_speaker", """
    SELECT episode_id, speaker, count(*) AS n_turns,
           CAST(sum(len(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+'), lambda t: regexp_matches(t, '(?i)^(u+m+|h+m+)$')))) AS BIGINT) AS n_fillers,
           CAST(sum((length(text) - length(replace(text, '[laughs]', ''))) / 8) AS BIGINT) AS n_laughs,
           CAST(sum((length(text) - length(replace(text, '[sigh]', ''))) / 6) AS BIGINT) AS n_sighs
    FROM (SELECT episode_id, speaker, CASE seg_idx % 4 WHEN 1 THEN 'Hmm, [laughs] ' || text WHEN 3 THEN 'umm... [sigh]' || text ELSE text END AS text FROM f_segments)
    GROUP BY episode_id, speaker""")
def agg_filler_by_speaker(spark, sf_dir):
    """Fillers and reactions of each speaker of an episode (injected into two
    of four turns)."""
    s, k = FX.segments(spark, sf_dir), F.col("seg_idx") % 4
    t = F.when(k == 1, F.concat(F.lit("Hmm, [laughs] "), F.col("text"))).when(k == 3, F.concat(F.lit("umm... [sigh]"), F.col("text"))).otherwise(F.col("text"))
    return D.fillers_by_speaker(s.withColumn("text", t))


@query("agg_chunks_to_doc", """
    SELECT doc_id, string_agg(text || chr(10) || chr(10), '' ORDER BY chunk_idx) AS text FROM f_chunks GROUP BY doc_id""")
def agg_chunks_to_doc(spark, sf_dir):
    return X.chunks_to_doc(FX.chunks(spark, sf_dir))


@query("flt_nonempty", f"""
    SELECT doc_id, page_no, length(page_text) AS n_chars FROM f_pages
    WHERE coalesce(length({strip('page_text')}), 0) > 0""")
def flt_nonempty(spark, sf_dir):
    """Non-empty guard: pages whose stripped text is not empty."""
    p = FX.pages(spark, sf_dir)
    return p.where(X.nonempty(T.py_strip("page_text"))).select(
        "doc_id", "page_no", F.length("page_text").alias("n_chars"))
