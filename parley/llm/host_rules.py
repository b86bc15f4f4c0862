"""Quality rules with host verdicts.

Each text is held against a few rules (too few words, repeated passages, too
many symbols, repeated lines, odd word lengths).  The failures are summed by
host; a host's failure rates are shrunk towards those of all hosts by a beta
prior, whose strength is estimated from how much the hosts differ (method of
moments).  A host whose shrunken rate of any rule is above ``limit`` is bad, and
that verdict is joined back to its documents: a host of three documents that
all fail says little, one of three thousand says much.

DataFrame functions only.  Texts are measured in one narrow pass and stored
without their texts; the failures are partial sums of each task, so a host of a
third of all rows costs no more than another.  The host table is broadcast
only if it was measured to be small; else it is joined by shuffle, where Spark
splits a hot host.

Defined results: a null or empty text has no words and fails the first rule; a
null host is a host of its own; rows repeat with their results; null ids stay;
an empty table gives an empty result.  Columns of ``docs`` named like a result
are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length")
LIMIT = 0.5
STRONGEST = 1e6            # prior strength, in documents, where hosts do not differ
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    """Host of a URL, lower-cased, without ``www.``; null where there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def alike_next(triples: Column) -> Column:
    """Whether each window equals the one after it.  ``triples``: the three
    words of each window and its place, sorted, so equal ones are neighbours."""
    same = lambda a, b: (a["0"] == b["0"]) & (a["1"] == b["1"]) & (a["2"] == b["2"])
    return F.zip_with(triples, F.slice(triples, 2, F.size(triples)), lambda a, b: F.coalesce(same(a, b), F.lit(False)))  # the last one meets null


def places_of_repeats(triples: Column, alike: Column) -> Column:
    """Places of the windows that equal a neighbour, rising."""
    both = F.zip_with(F.concat(F.array(F.lit(False)), alike), alike, lambda before, after: before | after)
    return F.sort_array(F.array_compact(F.zip_with(triples, both, lambda t, twice: F.when(twice, t["3"]))))


def measured(docs: DataFrame, text: str) -> DataFrame:
    """Adds the measures of a text: n_words, word_chars, n_symbols, n_lines
    (with a word), n_dup_lines, n_repeat_words."""
    size = lambda c: F.size(c).cast("long")
    text = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumns({"_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
                             "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))})
    m = F.size("_words") - 2
    window = F.arrays_zip(F.slice("_words", 1, m), F.slice("_words", 2, m), F.slice("_words", 3, m), F.sequence(F.lit(0), m - 1))
    docs = docs.withColumns({"n_words": size("_words"), "word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_lines": size("_lines"),
                             "n_dup_lines": size("_lines") - size(F.array_distinct("_lines")), "_windows": F.when(m > 1, F.sort_array(window))})
    docs = docs.withColumn("_alike", alike_next(F.col("_windows")))
    docs = docs.withColumn("_at", places_of_repeats(F.col("_windows"), F.col("_alike")))
    # Each repeated window covers its words up to the next one.
    steps = F.zip_with("_at", F.slice("_at", 2, F.size("_at")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda n, x: n + x), F.lit(0)).cast("long")
    return docs.withColumn("n_repeat_words", repeated).drop("_words", "_lines", "_windows", "_alike", "_at")


def failures() -> dict[str, Column]:
    """The rules over the measures."""
    n = F.col("n_words")
    return {"few_words": n < 50,
            "repeats": 100 * F.col("n_repeat_words") > 50 * n,
            "symbols": 100 * F.col("n_symbols") > 10 * n,
            "dup_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
            "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n)}


def beta_prior(n: float, squares: float, hosts: int, failed: float, spread: float) -> tuple[float, float]:
    """Parameters of the beta distribution of host rates by the method of
    moments.  ``n`` documents, ``failed`` of them; ``squares``: sum of the
    squared sizes of hosts; ``spread``: sum of size times squared distance of the
    host's rate from the mean.  Hosts that differ no more than by chance give
    the strongest prior."""
    mean = failed / n
    within = mean * (1 - mean)
    room = n - squares / n - (hosts - 1)
    alike = (spread - within * (hosts - 1)) / (within * room) if within > 0 and room > 0 else 0.0
    strength = min((1 - alike) / alike, STRONGEST) if alike > 0 else STRONGEST
    strength = max(strength, 1e-6)
    return mean * strength, (1 - mean) * strength


def host_verdicts(rows: DataFrame, host: str = "host", limit: float = LIMIT) -> DataFrame:
    """``host, host_docs, host_<rule>`` (the shrunken rates), ``host_rate`` (the
    largest) and ``host_bad``, for rows with a boolean column of each rule."""
    sums = stored(rows.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), *[F.count_if(F.col(r)).alias(f"_k_{r}") for r in RULES]), "hosts")
    n = F.col("host_docs")
    spread = [F.sum(F.col(f"_k_{r}").cast("double") * F.col(f"_k_{r}") / n) for r in RULES]
    total = sums.agg(F.sum(n), F.sum(n.cast("double") * n), F.count(F.lit(1)), *[F.sum(f"_k_{r}") for r in RULES], *spread).first()  # one row
    if not total[0]:
        return sums.select(host, "host_docs", *[F.lit(0.0).alias(f"host_{r}") for r in RULES], F.lit(0.0).alias("host_rate"), F.lit(False).alias("host_bad"))
    rates = {}
    for i, r in enumerate(RULES):
        failed = total[3 + i]
        a, b = beta_prior(float(total[0]), total[1], total[2], float(failed), total[3 + len(RULES) + i] - failed * failed / total[0])
        rates[f"host_{r}"] = (F.col(f"_k_{r}") + F.lit(a)) / (n + F.lit(a + b))
    worst = F.greatest(*rates.values())
    return sums.select(host, "host_docs", *[c.alias(k) for k, c in rates.items()], worst.alias("host_rate"), (worst > limit).alias("host_bad"))


def quality(docs: DataFrame, host: Column, text_col: str = "text", id_col: str = "doc_id", limit: float = LIMIT) -> DataFrame:
    """``doc_id, host``, the measures, a column for each rule, ``base_failed``
    (too few words or repeated passages), the host's columns of
    :func:`host_verdicts`, and ``kept``: neither base_failed nor of a bad host."""
    rows = measured(docs.select(F.col(id_col).alias(id_col), host.cast("string").alias("host"), F.col(text_col).alias("_text")), "_text").drop("_text")
    rows = stored(rows.withColumns(failures()), "measures")
    verdicts = stored(host_verdicts(rows, limit=limit), "verdicts")
    size = verdicts.agg(F.sum(F.coalesce(F.octet_length("host"), F.lit(0)) + 16 * len(verdicts.columns))).first()[0]
    table = verdicts.withColumnRenamed("host", "_host")
    if (size or 0) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    out = rows.join(table, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    failed = reduce(lambda a, b: a | b, [F.col("few_words"), F.col("repeats")])
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad"))
