"""Descriptive statistics, duplicates, the leakage audit and review samples of a labelled corpus.

A corpus has id, raw_text, body_text, label, template_group, difficulty, has_header, has_signature, has_quoted_reply,
template_id, variation_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.scratch import written
from ..functions.stats import share_text

FINDING = ["severity", "category", "feature", "labels", "count", "record_ids", "details"]
FLAGS = ("has_header", "has_signature", "has_quoted_reply")


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """Counts and shares of all rows by columns."""
    total = df.agg(F.count("*").alias("total"))
    return df.groupBy(*columns).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(*columns, "n", (F.col("n") / F.col("total")).alias("share"))


def class_distribution(df: DataFrame) -> DataFrame:
    """Per label: rows and their share of all with two digits (half of exact ties to even); rows without a label are a label of their own."""
    return counts_by(df, "label").select("label", F.col("n").alias("count"), share_text(F.col("share")).alias("ratio"))


def corpus_counts(df: DataFrame) -> DataFrame:
    """Per label: rows, distinct templates and variations, flags and their shares."""
    return df.groupBy("label").agg(
        F.count("*").alias("n"), F.countDistinct("template_id").alias("templates"), F.countDistinct(F.struct("template_id", "variation_id")).alias("variations"),
        *[F.count_if(F.col(f)).alias(f) for f in FLAGS], *[F.avg(F.col(f).cast("double")).alias(f + "_share") for f in FLAGS],
    )


def length_stats(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Mean, exact median, least, most and population deviation of characters, tokens and lines by label."""
    c = F.col(text)
    sizes = df.select("label", F.length(c).alias("characters"), F.size(X.tokens(c)).alias("tokens"), F.size(F.split(c, "\n")).alias("lines"))
    long = sizes.unpivot("label", ["characters", "tokens", "lines"], "measure", "value")
    return long.groupBy("label", "measure").agg(
        F.avg("value").alias("mean"), F.median("value").alias("median"), F.min("value").alias("least"), F.max("value").alias("most"), F.stddev_pop("value").alias("deviation")
    )


KINDS = ("exact", "normalized")


def _text_hashes(df: DataFrame, wanted: tuple[str, ...], keep: tuple[str, ...] = ("id", "label", "template_group")) -> DataFrame:
    """(*keep, match_type, source_field, canonical_sha256) of raw and body text; only wanted kinds are made."""
    config = X.CleanConfig(unicode=False)
    kinds = []
    for source in ("raw_text", "body_text"):
        exact, plain = F.col(source), X.normalize(X.clean(source, config), config)
        kinds += [F.struct(F.lit(kind).alias("match_type"), F.lit(source).alias("source_field"), F.sha2(value, 256).alias("canonical_sha256")) for kind, value in (("exact", exact), ("normalized", plain)) if kind in wanted]
    return df.select(*keep, F.explode(F.array(*kinds)).alias("k")).select(*keep, "k.*")


def duplicate_counts(df: DataFrame, by: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(by, match_type, n): how many groups of equal texts there are. Only hashes are moved."""
    long = _text_hashes(df, kinds, (by,)).withColumn("h", F.unhex("canonical_sha256")).where("h IS NOT NULL")
    groups = long.groupBy(by, "match_type", "source_field", "h").agg(F.count("*").alias("n")).where("n > 1")
    return groups.groupBy(by, "match_type").agg(F.count("*").alias("n"))


def duplicate_groups(df: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Groups of two or more equal texts: exact and normalized, of raw and body text, with sorted ids, labels, groups.
    Texts meet by their SHA-256, so no text is shuffled."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    long = _text_hashes(df, kinds).withColumn("id", F.col("id").cast("string"))
    return long.groupBy("match_type", "source_field", "canonical_sha256").agg(F.count("*").alias("record_count"), joined("id").alias("record_ids"), joined("label").alias("labels"), joined("template_group").alias("template_groups")).where("record_count > 1")


def duplicate_records(df: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(match_type, source_field, canonical_sha256, id): a row for each record of each group of equal texts."""
    keys, long = ["match_type", "source_field", "canonical_sha256"], _text_hashes(df, kinds)
    groups = long.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return long.join(groups, keys, "left_semi").select(*keys, "id")


def group_audit(df: DataFrame) -> DataFrame:
    """One row: groups, groups with several labels, whether groups are a structure, and the splitter to use."""
    groups = df.groupBy("template_group").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))
    row = groups.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.count_if(F.col("labels") > 1).alias("spanning"), F.max("n").alias("largest"))
    structure = (F.col("groups") > 0) & (F.col("groups") < F.col("rows"))
    return row.select("*", structure.alias("has_group_structure"), F.when(structure & (F.col("spanning") == 0), "stratified_group").otherwise("stratified").alias("splitter"))


# --- single rules of the leakage audit; audit.leakage has them all in one table


def _findings(df: DataFrame, severity: str, category: str, feature: Column, details: str, by: list[str]) -> DataFrame:
    made = df.withColumn("feature", feature.cast("string"))
    keys = list(dict.fromkeys(["feature", *by]))
    joined = lambda c: F.array_join(F.array_sort(c), "|")
    return made.groupBy(*keys).agg(joined(F.collect_set("label")).alias("labels"), F.count("*").alias("count"), joined(F.collect_list(F.col("id").cast("string"))).alias("record_ids")).select(
        F.lit(severity).alias("severity"), F.lit(category).alias("category"), "feature", "labels", "count", "record_ids", F.lit(details).alias("details")
    )


def label_literals(df: DataFrame, labels: list[str]) -> DataFrame:
    """A formal label name inside a text: one finding for each row and label."""
    named = X.let(X.casefold(F.concat_ws("\n", "raw_text", "body_text")), lambda folded: F.filter(F.array(*map(F.lit, labels)), lambda x: F.contains(folded, x)))
    hit = df.select("id", "label", F.explode_outer(named).alias("name")).where("name is not null")
    return _findings(hit, "error", "label_literal", F.col("name"), "formal label name appears in content", ["id"])


def template_literals(df: DataFrame) -> DataFrame:
    hit = df.select("id", "label", F.explode(F.filter(F.array("template_id", "template_group"), lambda x: F.contains(X.casefold("raw_text"), X.casefold(x)))).alias("name"))
    return _findings(hit, "error", "template_literal", F.col("name"), "template identifier appears in raw text", ["id"])


def mixed_groups(df: DataFrame) -> DataFrame:
    mixed = df.groupBy("template_group").agg(F.countDistinct("label").alias("k")).where("k > 1").select("template_group")
    return _findings(df.join(mixed, "template_group", "left_semi"), "error", "template_group_label_mixing", F.col("template_group"), "one template_group contains multiple labels", [])


def group_shares(df: DataFrame) -> DataFrame:
    """Groups of each label and the share of its largest."""
    sizes = df.groupBy("label", "template_group").agg(F.count("*").alias("n"))
    return sizes.groupBy("label").agg(F.count("*").alias("groups"), (F.max("n") / F.sum("n")).alias("largest_share"), F.max("n").alias("largest"), F.sum("n").alias("n"))


def concentrated_groups(df: DataFrame, min_groups: int, max_share: float) -> DataFrame:
    """(label, category) where a label has too few groups or too large a one."""
    shares = group_shares(df)
    few = shares.where(F.col("groups") < min_groups).select("label", F.lit("template_count").alias("category"), F.lit("error").alias("severity"))
    large = shares.where(F.col("largest_share") > max_share).select("label", F.lit("template_concentration").alias("category"), F.lit("warning").alias("severity"))
    return few.unionByName(large)


def one_class_flags(df: DataFrame, fields=(*FLAGS, "difficulty")) -> DataFrame:
    """Values of structural fields that occur in one class only."""
    long = df.select("id", "label", F.explode(F.array(*[F.concat(F.lit(f + "="), F.col(f).cast("string")) for f in fields])).alias("value"))
    one = long.groupBy("value").agg(F.countDistinct("label").alias("k"), F.min("label").alias("labels"), F.count("*").alias("count")).where("k = 1")
    return one.select(F.col("value").alias("feature"), "labels", "count")


def component_spread(df: DataFrame, component: str, max_spread: float) -> DataFrame:
    """Values of a shared component whose shares by class differ by more than max_spread; absent classes count as 0."""
    totals = df.groupBy("label").agg(F.count("*").alias("total"))
    cells = df.groupBy(F.col(component).alias("value"), "label").agg(F.count("*").alias("n")).join(totals, "label")
    k = totals.agg(F.count("*").alias("k"))
    spread = cells.groupBy("value").agg(F.max(F.col("n") / F.col("total")).alias("most"), F.min(F.col("n") / F.col("total")).alias("low"), F.count("*").alias("seen")).crossJoin(F.broadcast(k))
    value = F.col("most") - F.when(F.col("seen") < F.col("k"), 0.0).otherwise(F.col("low"))
    return spread.where("k > 1").select(F.col("value").cast("string").alias("feature"), value.alias("spread")).where(F.col("spread") > max_spread)


def header_features(df: DataFrame, min_count: int) -> DataFrame:
    """Header values, sender domains and signatures seen min_count times or more and in one class only. A record counts
    once for each match."""
    lines = F.regexp_extract_all("raw_text", F.lit(r"(?im)^((?:from|subject):[^\n]*)"), F.lit(1))
    long = df.select("id", "label", F.explode(lines).alias("line"))
    name, value = F.lower(F.substring_index("line", ":", 1)), F.trim(F.regexp_replace("line", r"^[^:]*:", ""))
    domain = F.when((name == "from") & F.contains(value, F.lit("@")), F.substring_index(value, "@", -1))
    made = long.select("id", "label", F.explode(F.array(F.concat(name, F.lit("="), value), F.concat(F.lit("sender_domain="), domain))).alias("feature")).where("feature is not null")
    return exclusive(made, min_count)


def exclusive(long: DataFrame, min_count: int, feature: str = "feature") -> DataFrame:
    """Features (rows id, label, feature) with min_count rows or more that all have one label."""
    return long.groupBy(F.col(feature).alias("feature")).agg(F.count("*").alias("count"), F.min("label").alias("labels"), F.max("label").alias("__m")).where((F.col("count") >= min_count) & (F.col("labels") == F.col("__m"))).select("feature", "labels", "count")


def exclusive_tokens(df: DataFrame, min_count: int, n: int = 1, text: str = "body_text") -> DataFrame:
    """Tokens (n = 1) or n-grams found in min_count documents or more, all of one class. Only (token, label) counts
    are shuffled, pre-aggregated where the text is read."""
    words = X.tokens(X.casefold(text))
    grams = F.array_distinct(words if n == 1 else X.word_ngrams(words, n))
    return exclusive(df.select("label", F.explode_outer(grams).alias("feature")).where("feature is not null"), min_count)


def length_ratio(df: DataFrame, max_ratio: float, text: str = "raw_text") -> DataFrame:
    """The ratio of the largest to the smallest mean length by class, where above max_ratio."""
    means = df.groupBy("label").agg(F.avg(F.length(text)).alias("mean"))
    return means.agg((F.max("mean") / F.min("mean")).alias("ratio"), F.count("*").alias("labels")).where(F.col("ratio") > max_ratio)


# --- review samples


def first_per_label(df: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("label").orderBy("id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def review_samples(df: DataFrame, per_label: int = 2, found: dict[str, DataFrame] | None = None) -> DataFrame:
    """(id, selection_reasons): the first of each label, the first of each difficulty and with each flag, the shortest, the
    longest, and every id of the tables in found (by reason). First is the least id."""
    reasons = [first_per_label(df, per_label).select("id", F.concat(F.lit("class_sample:"), "label").alias("reason"))]
    reasons.append(df.where("difficulty is not null").groupBy("difficulty").agg(F.min("id").alias("id")).select("id", F.concat(F.lit("difficulty:"), "difficulty").alias("reason")))
    size, marks = F.length("raw_text"), {f: f for f in FLAGS} | {c: r for c, r in (("contains_negation", "negation"), ("multi_intent", "multi_intent")) if c in df.columns}
    picks = {"shortest": F.min_by("id", F.struct(size, F.col("id"))), "longest": F.min_by("id", F.struct(-size, F.col("id")))}
    picks |= {reason: F.min(F.when(F.col(flag), F.col("id"))) for flag, reason in marks.items()}
    one = df.agg(*[pick.alias(reason) for reason, pick in picks.items()])
    reasons.append(one.unpivot([], list(picks), "reason", "id").where("id is not null").select("id", "reason"))
    reasons += [ids.select("id").distinct().select("id", F.lit(reason).alias("reason")) for reason, ids in (found or {}).items()]
    out = reasons[0]
    for r in reasons[1:]:
        out = out.unionByName(r)
    return out.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("selection_reasons"))


def spot_review(df: DataFrame) -> DataFrame:
    """One record for each group, the shortest and the longest text taking their group's place."""
    size = F.length("raw_text")
    ends = df.agg(F.min_by("id", F.struct(size, F.col("id"))).alias("short"), F.max_by("id", F.struct(size, -F.col("id"))).alias("long"))
    marked = df.crossJoin(F.broadcast(ends)).withColumn("order", F.when(F.col("id") == F.col("short"), 0).when(F.col("id") == F.col("long"), 1).otherwise(2))
    return marked.groupBy("template_group").agg(F.min_by("id", F.struct("order", "id")).alias("id"), F.min("order").alias("order")).select("template_group", "id", F.element_at(F.array(F.lit("shortest"), F.lit("longest"), F.lit("group")), F.col("order") + 1).alias("reason"))


def covering_review(df: DataFrame, records: DataFrame, finding: list[str], max_rounds: int = 1000) -> DataFrame:
    """(template_group, id, reason): one record for each group, chosen so that findings are seen in a review.

    records: rows (finding columns, id) of the records behind findings. Greedy in rounds, all groups at once: every finding without a
    chosen record nominates the record that has most such findings, ties by id; every group without a record takes the best nominated
    one, ties by id. That goes on until no finding without a record has one in a group that is still free, so each finding that any
    free group could show is shown. The groups left take the record that spot_review has for them. Repeated rows count once; rows
    without a group are a group; null ids are left out.
    """
    rows = df.where("id IS NOT NULL").groupBy("id").agg(F.min("template_group").alias("template_group"))
    # half a digest names a finding; dealt out by id once, for the distinct pairs and the join
    pairs = records.select("id", F.unhex(F.substring(F.sha2(F.to_json(F.struct(*finding)), 256), 1, 32)).alias("f")).repartition("id").distinct()
    open_pairs = written(pairs.join(rows, "id").select("id", "f", F.coalesce("template_group", F.lit("")).alias("g")), "open-findings")
    chosen = written(open_pairs.select("g", "id").limit(0), "chosen")
    for _ in range(max_rounds):
        gain = open_pairs.groupBy("id").agg(F.count("*").alias("n"))
        best = open_pairs.join(gain, "id").groupBy("f").agg(F.min(F.struct((-F.col("n")).alias("n"), "id", "g")).alias("b"))
        taken = written(best.select("b.*").distinct().groupBy("g").agg(F.min(F.struct("n", "id")).alias("b")).select("g", F.col("b.id").alias("id")), "taken")
        if taken.isEmpty():
            break
        chosen = written(chosen.unionByName(taken), "chosen")
        seen = open_pairs.join(taken.select("id"), "id", "left_semi").select("f").distinct()
        open_pairs = written(open_pairs.join(seen, "f", "left_anti").join(taken.select("g"), "g", "left_anti"), "open-findings")
    else:
        raise ValueError(f"findings are left after {max_rounds} rounds")
    base = spot_review(df.where("id IS NOT NULL")).withColumn("g", F.coalesce("template_group", F.lit("")))
    found = chosen.withColumnRenamed("id", "own")
    return base.join(found, "g", "left").select("template_group", F.coalesce("own", "id").alias("id"), F.when(F.col("own").isNotNull() & (F.col("own") != F.col("id")), "finding").when(F.col("own").isNotNull(), F.concat("reason", F.lit("|finding"))).otherwise(F.col("reason")).alias("reason"))


def compare_flag_ratios(population: DataFrame, misclassified: DataFrame, flags=FLAGS) -> DataFrame:
    """(flag, share in the population, share among misclassified, z): pooled two-proportion statistic."""
    from ..functions.stats import two_proportion_z

    long = lambda df, n, x: df.select(*flags).unpivot([], list(flags), "flag", "value").groupBy("flag").agg(F.count("*").alias(n), F.count_if(F.col("value")).alias(x))
    both = long(population, "n1", "x1").join(long(misclassified, "n2", "x2"), "flag")
    return both.select("flag", (F.col("x1") / F.col("n1")).alias("population_share"), (F.col("x2") / F.col("n2")).alias("misclassified_share"), two_proportion_z(F.col("x2"), F.col("n2"), F.col("x1"), F.col("n1")).alias("z"))
