"""Document text operators: pages, character cap, word chunks, ordered
re-assembly, and the rule-based cleanup.

Narrow operators (``word_chunks``, cleanup) are per-row column expressions
with no shuffle.  Re-assembly groups by document; the group is bounded by
the document it came from (one input row) or by the character cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.fixed import CHUNK_SEPARATOR, CHUNK_WORDS, MAX_CHARS, PAGE_SEPARATOR
from parley.operators.scan import running_sum


def split_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Page table: one row per line of the text, 0-based ``page_no``."""
    return (docs.where(F.col(text).isNotNull())
            .select(key, F.posexplode_outer(F.split(F.col(text), "\n")).alias("page_no", "page_text")))


def ordered_concat(df: DataFrame, keys, order: str, value: str, suffix: str, out: str,
                   *extra_aggs: Column) -> DataFrame:
    """Per key: ``''.join(v + suffix for v in values ordered by order)``.

    ``collect_list`` order is not defined, so the (order, value) structs are
    sorted before joining.  Lists are built map-side (partial aggregation)
    and merged per key.  The result is one string per key, so a group can
    never hold more than fits in one row: the group is bounded by its output,
    which is the document or reply being rebuilt.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(
        F.array_join(F.transform(parts, lambda s: F.concat(s["v"], F.lit(suffix))), "").alias(out),
        *extra_aggs)


def char_offsets(pages: DataFrame, key: str = "doc_id", order: str = "page_no",
                 text: str = "page_text") -> DataFrame:
    """Add ``start_char``: characters before the page, each earlier page
    counting its length plus the page separator."""
    return running_sum(pages, key, order, (F.length(text) + len(PAGE_SEPARATOR)).cast("long"),
                       "start_char", inclusive=False)


def pages_to_doc(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Document text: each page followed by a newline, in page order."""
    return ordered_concat(pages, key, "page_no", "page_text", PAGE_SEPARATOR, "text")


def cap_document(pages: DataFrame, max_chars: int = MAX_CHARS, key: str = "doc_id") -> DataFrame:
    """Cumulative character cap over ordered pages.

    Pages are appended (with a newline) until the length exceeds
    ``max_chars``; the result is then cut to ``max_chars``.  Pages starting
    after the cap are never concatenated, so the group stays bounded.
    Output: key, text, n_chars, truncated.
    """
    if max_chars < 0:
        raise ValueError("max_chars must not be negative")
    off = char_offsets(pages, key)
    kept = off.where(F.col("start_char") <= max_chars)
    doc = kept.groupBy(key).agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("page_no", "page_text"))),
            lambda s: F.concat(s["page_text"], F.lit(PAGE_SEPARATOR))), "").alias("_full"),
        F.max(F.col("start_char") + F.length("page_text") + len(PAGE_SEPARATOR)).alias("_total"))
    return doc.select(key,
                      F.substring("_full", 1, max_chars).alias("text"),
                      F.least(F.col("_total"), F.lit(max_chars)).cast("long").alias("n_chars"),
                      (F.col("_total") > max_chars).alias("truncated"))


def word_chunks(docs: DataFrame, n: int = CHUNK_WORDS, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Word-bounded chunks: exactly ``n`` words each (the last may be shorter),
    words split on runs of Unicode whitespace and joined by single spaces.
    Empty texts give no chunk.  Output: key, chunk_idx, n_words, text."""
    if n < 1:
        raise ValueError("chunk size must be at least one word")
    # The word array is projected once and referenced by name: inlined into
    # the slicing lambda it would be re-split for every chunk.
    ws = docs.select(key, T.words(F.col(text)).alias("_ws"))
    sliced = ws.select(key, T.chunk_slices(F.col("_ws"), n).alias("_sl"))
    # posexplode_outer: the inner form makes the optimizer infer a
    # ``size(...) > 0`` filter that copies the whole expression below the
    # projection and re-evaluates it; empty arrays are dropped explicitly.
    return (sliced.select(key, F.posexplode_outer("_sl").alias("chunk_idx", "_w"))
            .where(F.col("_w").isNotNull())
            .select(key, "chunk_idx", F.size("_w").alias("n_words"), F.array_join("_w", " ").alias("text")))


def chunks_to_doc(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_idx",
                  text: str = "text") -> DataFrame:
    """Cleaned document: each chunk followed by a blank line, in order."""
    return ordered_concat(chunks, key, order, text, CHUNK_SEPARATOR, "text")


def rule_clean(df: DataFrame, text: str = "text") -> DataFrame:
    """Rule-based cleanup of ``text`` plus word counts before and after."""
    return df.withColumn("words_before", T.word_count(F.col(text))) \
             .withColumn(text, T.clean_text(F.col(text))) \
             .withColumn("words_after", T.word_count(F.col(text)))


def nonempty(c: Column) -> Column:
    """Non-empty guard for strings (null counts as empty)."""
    return F.coalesce(F.length(c), F.lit(0)) > 0


def join_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines that the page broke are joined again, so that a text can be read
    aloud: a broken sentence by a space, a broken word without its hyphen (with it
    if the document writes it so elsewhere).  Blank lines, headings, list items and
    labels stay apart.  Replaces ``text``; adds n_lines_before, n_lines_after,
    words_before and words_after (a joined word counts once).  Narrow; each step is a
    column of its own, so no array is computed twice.  A null text stays null."""
    t = F.col(text)
    d = docs.withColumn("_lines", F.split(t, "\n"))
    d = d.withColumn("_kinds", T.line_kinds(F.col("_lines")))
    d = d.withColumn("_cut", T.cut_words(F.col("_kinds")))
    wanted = F.array_distinct(F.array_remove("_cut", ""))
    d = d.withColumn("_known", F.when(F.size(wanted) > 0, F.array_intersect(wanted, F.regexp_extract_all(t, F.lit(T.HYPHENATED), F.lit(0))))
                     .otherwise(F.array().cast("array<string>")))
    d = d.withColumn("_joints", T.line_joints(F.col("_kinds"), F.col("_cut"), F.col("_known")))
    d = d.withColumn("_joined", T.lines_joined(F.col("_kinds"), F.col("_joints")))
    kept = F.size(F.filter("_joints", lambda j: j.isin("line", "end")))
    return d.select(*[F.col("_joined").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns],
                    F.size("_lines").alias("n_lines_before"), kept.alias("n_lines_after"),
                    T.word_count(t).alias("words_before"), T.word_count("_joined").alias("words_after"))
