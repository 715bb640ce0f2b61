"""Quality rules on documents, with host-level verdicts under an empirical beta prior. DataFrame functions only.

A document fails its base rules by too few words or by too many repeated ones. Failures are counted for each host (the
`source` column), every host's failure rate is shrunk towards that of the corpus by a beta prior fitted to all hosts,
and hosts whose shrunk rate is too high take all their documents with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, maybe_broadcast, materialize, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Hosts with a higher shrunk failure rate are rejected.
MAX_HOST_RATE = 0.5
#: Fixed: white space between words, characters counted as symbols.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Strength of the prior (as so many documents) if all hosts fail alike, and at least.
MOST_STRENGTH, LEAST_STRENGTH = 1000.0, 2.0


#: Counts over the words w of a text. Everything a lambda refers to is bound by a lambda around it (a one-element array
#: takes the place of a let), so no rewrite of the plan can make it evaluate a text's words once for each word.
#: The 3-word windows are sorted by hash, so equal ones are neighbours; the places of repeated ones are sorted, and each
#: covers up to three words more than those before it.
_COUNTS = """
transform(array({words}), w -> struct(
  size(w) AS n,
  if(size(w) < 4, 0, transform(
    array(array_sort(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i)))),
    s -> aggregate(
      array_sort(array_distinct(flatten(transform(
        filter(sequence(1, size(s) - 1), j -> s[j].h = s[j - 1].h), j -> array(s[j - 1].i, s[j].i))))),
      struct(-3 AS last, 0 AS n),
      (acc, i) -> struct(i AS last, acc.n + least(3, i - acc.last) AS n),
      acc -> acc.n))[0]) AS repeated))[0]"""
_WORDS = r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w != '')"


def word_counts() -> Column:
    """struct(n: words, repeated: words in 3-word windows found twice or more) of the column text."""
    return F.expr(_COUNTS.format(words=_WORDS))


def base_failed() -> Column:
    """Whether the column text fails its own rules; null text has no words."""
    return F.expr(f"transform(array({_COUNTS.format(words=_WORDS)}), c -> c.n < {MIN_WORDS} OR 100L * c.repeated > {MAX_REPEAT_PERCENT}L * c.n)[0]")


def with_rules(docs: DataFrame) -> DataFrame:
    """docs (text and any others) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    c_, lines_ = free_name(docs, "counts"), free_name(docs, "lines")
    w = docs.withColumn(c_, word_counts()).withColumn(lines_, lines)
    n, repeated = F.col(f"{c_}.n"), F.col(f"{c_}.repeated")
    return w.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace(text, BLANK, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long"),
        "n_repeat_words": repeated.cast("long"),
        "base_failed": (n < MIN_WORDS) | (100 * repeated.cast("long") > MAX_REPEAT_PERCENT * n),
    }).drop(c_, lines_)


def host_verdicts(marked: DataFrame, host: str = "source", failed: str = "base_failed", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n, failures, rate, rejected) for each host; a null host is a host like any other.

    The beta prior comes from all hosts by the method of moments: its mean is the corpus's failure rate, its strength
    follows from how much more the hosts' rates vary than chance alone would have them. Hosts are pre-aggregated
    where they are read, so a host with a third of the rows is no hot spot.
    """
    hosts = marked.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures"))
    own = F.col("failures") / F.col("n")
    total = hosts.agg(
        F.count("*").cast("double").alias("k"),
        F.sum("n").cast("double").alias("all_n"),
        (F.sum("failures") / F.sum("n")).alias("mean"),
        F.sum(own * own * F.col("n")).alias("square"),
    )
    variance = F.col("square") / F.col("all_n") - F.col("mean") * F.col("mean")
    noise = F.col("mean") * (1 - F.col("mean")) * F.col("k") / F.col("all_n")
    between = variance - noise
    strength = F.when(between > 0, F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), F.col("mean") * (1 - F.col("mean")) / between - 1))).otherwise(F.lit(MOST_STRENGTH))
    prior = total.select("mean", strength.alias("strength"))
    rated = hosts.join(F.broadcast(prior)).withColumn("rate", (F.col("failures") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength")))
    return rated.select("host", "n", "failures", "rate", (F.col("rate") > max_rate).alias("rejected"))


def quality_filter(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that neither their own rules nor their host's verdict reject, with docs's columns.

    Every text is judged once: documents and verdicts are written to the shared folder, hosts are counted there, and only
    rejected hosts, counted first, are joined back.
    """
    failed, host_ = free_name(docs, "failed"), free_name(docs, "rejected_host")
    marked, _ = materialize(docs.withColumn(failed, base_failed()), "judged")
    rejected, _ = materialize(host_verdicts(marked, host, failed, max_rate).where("rejected").select(F.col("host").alias(host_)), "rejected-hosts")
    kept = marked.where(~F.col(failed)).drop(failed)
    n = rejected.count()
    if n:
        kept = kept.join(maybe_broadcast(rejected, n), F.col(host).eqNullSafe(F.col(host_)), "left_anti")
    return kept


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base verdict and final verdict of every row of documents, repeated ones each. Null, empty and blank texts have no
    words and fail; a null source is a host like any other; an empty table gives no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    counted = with_rules(docs).drop("text")
    counted, _ = materialize(counted, "quality")
    hosts, _ = materialize(host_verdicts(counted).where("rejected").select(F.col("host").alias("rejected_host"), "rejected"), "rejected-hosts")
    named = counted.join(maybe_broadcast(hosts, hosts.count()), F.col("source").eqNullSafe(F.col("rejected_host")), "left")
    kept = ~F.col("base_failed") & F.col("rejected").isNull()
    return named.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


_RULES_SQL = r"""
w AS (SELECT doc_id, source, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, (SELECT unnest(range(1, (SELECT max(len(ws)) FROM w) + 1)) AS i) WHERE i <= len(ws) - 2),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM u) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
rules AS (SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        len(ws) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(ws) AS base_failed
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM rules GROUP BY 1),
total AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(n) AS n, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2 AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v - m * (1 - m) * k / n > 0 THEN greatest(2.0, least(1000.0, m * (1 - m) / (v - m * (1 - m) * k / n) - 1)) ELSE 1000.0 END AS s FROM total),
bad AS (SELECT source FROM hosts, prior WHERE (f + m * s) / (hosts.n + s) > 0.5)
"""

SQL = {
    "op6_quality_rules": "WITH " + _RULES_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM rules.source) AS kept
FROM rules
"""
}
