"""The contamination experiment: nested balanced assignment, contaminated corpora, transitions, paired tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.stats import mcnemar_statistic, safe_divide
from ..sources.scratch import few, written
from .errors import must_match
from .folds import seeded

# Levels, their shares of a class, places, sentences of a subtopic.
LEVELS = ("C0", "C10", "C20", "C30")
FRACTIONS = {"C10": 0.1, "C20": 0.2, "C30": 0.3}
POSITIONS = ("early", "mid", "end")
SENTENCES = 12


def applies_at(level: Column, min_level: Column) -> Column:
    """Whether a sample that is contaminated from min_level on is so at level; never at C0 or without assignment."""
    at = lambda c: F.array_position(F.array(*map(F.lit, LEVELS)), c)
    return F.coalesce((level != "C0") & (at(level) >= at(min_level)), F.lit(False))


def assignment(df: DataFrame, seed: int = 42) -> DataFrame:
    """Which samples get which subtopic, sentence and place, and from which level on.

    Within a class groups are alternated by difficulty and give one sample a round, in seeded order; the first tenth is
    contaminated from C10 on, the second from C20, the third from C30. Other classes, sentences and places are drawn in
    blocks that hold each once, in seeded order.
    """
    first = df.groupBy("label", "template_group").agg(F.min_by("difficulty", "id").alias("d"), F.count("*").alias("n"))
    groups = first.withColumn("k", F.row_number().over(Window.partitionBy("label", "d").orderBy("template_group"))).withColumn("group_order", F.row_number().over(Window.partitionBy("label").orderBy("k", "d", "template_group")))
    rounds = df.withColumn("round", F.row_number().over(Window.partitionBy("label", "template_group").orderBy(seeded(seed, "label", F.lit("group"), "template_group", "id"), "id")))
    ordered = rounds.join(groups.select("label", "template_group", "group_order"), ["label", "template_group"])
    ranked = ordered.withColumn("selection_rank", F.row_number().over(Window.partitionBy("label").orderBy("round", "group_order")) - 1)
    sizes = df.groupBy("label").agg(F.count("*").alias("size"))
    counted = ranked.join(sizes, "label")
    upto = {level: F.bround(F.col("size") * F.lit(share)).cast("int") for level, share in FRACTIONS.items()}
    level = F.when(F.col("selection_rank") < upto["C10"], "C10").when(F.col("selection_rank") < upto["C20"], "C20").otherwise("C30")
    chosen = counted.where(F.col("selection_rank") < upto["C30"]).withColumn("min_level", level)
    labels = df.select(F.col("label").alias("other")).distinct()
    k = labels.count()
    if k < 2:
        raise ValueError("two labels at least are needed")
    drawn = chosen.withColumn("block", F.floor(F.col("selection_rank") / (k - 1)).cast("int"))
    blocks = drawn.select("label", "block").distinct().join(labels, F.col("label") != F.col("other"))
    blocks = blocks.withColumn("at", F.row_number().over(Window.partitionBy("label", "block").orderBy(seeded(seed, "label", F.lit("subtopic"), "block", "other"))) - 1)
    placed = drawn.withColumn("at", (F.col("selection_rank") % (k - 1)).cast("int")).join(blocks.select("label", "block", "at", F.col("other").alias("subtopic_label")), ["label", "block", "at"])
    draws = placed.withColumn("draw", F.row_number().over(Window.partitionBy("label", "subtopic_label").orderBy("selection_rank")) - 1)
    variant = _dealt(seed, "variant", [F.lit(i).cast("string") for i in range(SENTENCES)])
    place = _dealt(seed, "position", [F.lit(p) for p in POSITIONS])
    return draws.select(
        F.col("id").alias("sample_id"), F.col("label").alias("main_label"), "subtopic_label", "template_group", "difficulty", "selection_rank", "min_level",
        variant.cast("int").alias("variant_id"), place.alias("insertion_position"),
    )


def _dealt(seed: int, what: str, items: list[Column]) -> Column:
    """The item of a draw: blocks of all items, each block in a seeded order of its own."""
    n = len(items)
    block = F.floor(F.col("draw") / n).cast("string")
    keyed = F.array_sort(F.array(*[F.struct(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("label"), F.col("subtopic_label"), F.lit(what), block, item), 256).alias("h"), item.alias("x")) for item in items]))
    return F.element_at(keyed, (F.col("draw") % n).cast("int") + 1)["x"]


def contaminate(df: DataFrame, assigned: DataFrame, sentences: DataFrame, levels=LEVELS) -> DataFrame:
    """The corpus at every level: id, contamination_level, body_text, raw_text, contaminated. Rows at C0 are unchanged.
    sentences: subtopic, variant_id, text."""
    planned = assigned.join(few(sentences.withColumnRenamed("text", "sentence")), (F.col("subtopic_label") == F.col("subtopic")) & (assigned["variant_id"] == sentences["variant_id"]), "left").select("sample_id", "min_level", "insertion_position", "sentence")
    rows = df.join(planned, df["id"] == planned["sample_id"], "left").withColumn("contamination_level", F.explode(F.array(*map(F.lit, levels))))
    hit = applies_at(F.col("contamination_level"), F.col("min_level"))
    body = F.when(hit, X.insert_paragraph("body_text", F.col("sentence"), F.col("insertion_position"))).otherwise(F.col("body_text"))
    made = rows.withColumn("contaminated", hit).withColumn("new_body", body)
    raw = F.when(F.col("contaminated"), X.splice_body("raw_text", "body_text", F.col("new_body"))).otherwise(F.col("raw_text"))
    return made.select("id", "label", "contamination_level", "contaminated", F.col("new_body").alias("body_text"), raw.alias("raw_text"))


def transitions(oof: DataFrame, assigned: DataFrame, baseline: str = "C0") -> DataFrame:
    """Counts of correct and wrong at the baseline and at each other level, for all, contaminated and other samples.
    Groups without samples have zeros. A sample missing at the baseline is an error."""
    right = F.col("true_label") == F.col("predicted_label")
    keys = ["condition", "model", "sample_id"]
    base = oof.where(F.col("contamination_level") == baseline).select(*keys, right.alias("before"))
    later = oof.where(F.col("contamination_level") != baseline).select(*keys, "contamination_level", right.alias("after"))
    joined = later.join(base, keys, "left")
    lost = F.raise_error(F.lit("a sample is missing at the baseline")).cast("boolean")
    both = joined.withColumn("before", F.coalesce("before", lost)).join(assigned.select("sample_id", "min_level"), "sample_id", "left")
    hit = applies_at(F.col("contamination_level"), F.col("min_level"))
    long = both.withColumn("grp", F.explode(F.array(F.lit("all"), F.when(hit, "contaminated").otherwise("not_contaminated"))))
    b, a = F.col("before"), F.col("after")
    cell = ["contamination_level", "condition", "model"]
    counts = long.groupBy(*cell, "grp").agg(F.count_if(b & a).alias("c2c"), F.count_if(b & ~a).alias("c2i"), F.count_if(~b & a).alias("i2c"), F.count_if(~b & ~a).alias("i2i"))
    dims = later.select(*cell).distinct().withColumn("grp", F.explode(F.array(*map(F.lit, ("all", "contaminated", "not_contaminated")))))
    return dims.join(counts, [*cell, "grp"], "left").na.fill(0, ["c2c", "c2i", "i2c", "i2i"])


def mcnemar(transition_table: DataFrame) -> DataFrame:
    """The statistic of each row of transitions()."""
    return transition_table.withColumn("statistic", mcnemar_statistic(F.col("c2i"), F.col("i2c")))


def pair_summary(oof: DataFrame, assigned: DataFrame, baseline: str = "C0") -> DataFrame:
    """Contaminated samples by level, cell, main class and subtopic: accuracy, that at the baseline, errors, and those
    pulled to the subtopic."""
    right = (F.col("true_label") == F.col("predicted_label")).cast("int")
    keys = ["condition", "model", "sample_id"]
    base = oof.where(F.col("contamination_level") == baseline).select(*keys, right.alias("before"))
    later = oof.where(F.col("contamination_level") != baseline).join(assigned.select("sample_id", "main_label", "subtopic_label", "min_level"), "sample_id")
    hit = later.where(applies_at(F.col("contamination_level"), F.col("min_level"))).join(base, keys)
    g = hit.groupBy("contamination_level", "condition", "model", "main_label", "subtopic_label").agg(
        F.count("*").alias("n"), F.sum(right).alias("correct"), F.sum("before").alias("correct_before"), F.count_if(F.col("predicted_label") == F.col("subtopic_label")).alias("pulled")
    )
    n, wrong = F.col("n"), F.col("n") - F.col("correct")
    return g.select(
        "contamination_level", "condition", "model", "main_label", "subtopic_label", "n", safe_divide(F.col("correct"), n).alias("accuracy"), safe_divide(F.col("correct_before"), n).alias("baseline_accuracy"),
        safe_divide(F.col("correct") - F.col("correct_before"), n).alias("difference"), wrong.alias("misclassified"), "pulled", safe_divide(F.col("pulled"), wrong).alias("pulled_rate"),
    )


def pulled_rates(oof: DataFrame, assigned: DataFrame, baseline: str = "C0") -> DataFrame:
    """By level and cell: errors among contaminated samples, how many went to the subtopic, and their share; zeros where a
    level has no such error."""
    cell = ["contamination_level", "condition", "model"]
    cells = oof.where(F.col("contamination_level") != baseline).select(*cell).distinct()
    found = pair_summary(oof, assigned, baseline).groupBy(*cell).agg(F.sum("misclassified").alias("misclassified"), F.sum(F.when(F.col("main_label") != F.col("subtopic_label"), F.col("pulled")).otherwise(0)).alias("pulled"))
    return cells.join(found, cell, "left").na.fill(0, ["misclassified", "pulled"]).withColumn("rate", safe_divide(F.col("pulled"), F.col("misclassified")))


def subtopic_features(features: DataFrame, sentences: DataFrame, connectors: tuple[str, ...] = ()) -> DataFrame:
    """features (feature and any others) with subtopics: those whose sentences have the feature as a word that is not a
    connector, sorted and joined by |; empty where none has it, or the feature is null. sentences: subtopic, text."""
    words = sentences.select("subtopic", F.explode(F.array_distinct(X.tokens(F.lower("text")))).alias("feature")).where(~F.col("feature").isin(*connectors))
    topics = words.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_set("subtopic")), "|").alias("subtopics"))
    return features.join(topics, "feature", "left").na.fill("", ["subtopics"])


def condition_statistics(assigned: DataFrame, levels=LEVELS) -> DataFrame:
    """(level, category, key, value): contaminated rows, pairs, places, sentences of each level."""
    rows = assigned.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).where(applies_at(F.col("level"), F.col("min_level")))
    kinds = {"total": F.lit("all"), "main_label": F.col("main_label"), "pair": F.concat_ws(">", "main_label", "subtopic_label"), "position": F.col("insertion_position"), "sentence": F.concat_ws("#", F.col("subtopic_label"), F.col("variant_id").cast("string"))}
    long = rows.select("level", F.explode(F.array(*[F.struct(F.lit(k).alias("category"), v.alias("key")) for k, v in kinds.items()])).alias("x"))
    return long.groupBy("level", F.col("x.category").alias("category"), F.col("x.key").alias("key")).agg(F.count("*").cast("double").alias("value"))


STATISTICS = (
    "total_count", "class_counts", "difficulty_counts", "template_group_counts", "duplicates", "near_duplicates", "contamination_rate", "main_subtopic_pairs", "insertion_position",
    "sentence_usage", "style_usage",
)


def level_statistics(df: DataFrame, assigned: DataFrame, sentences: DataFrame, levels=LEVELS, near_duplicates: bool = True, duplicates: bool = True) -> DataFrame:
    """(level, category, key, value) of every level of the corpus df, the categories being STATISTICS: rows, classes, difficulties, groups;
    groups of equal and of normalized texts, similar pairs at the default threshold, each if wanted, as these alone read texts; the share contaminated, pairs of topics,
    places, sentences and styles. A key without rows has none, but duplicates and the rate are always told."""
    from .neardup import exact_summary
    from .quality import duplicate_counts

    long = lambda rows, level: rows.select(F.lit(level).alias("level"), "category", F.col("key").cast("string").alias("key"), F.col("value").cast("double").alias("value"))
    total = df.count()
    kinds = {"total_count": F.lit("total_count"), "class_counts": F.col("label"), "difficulty_counts": F.col("difficulty"), "template_group_counts": F.col("template_group")}
    marks = F.explode(F.array(*[F.struct(F.lit(k).alias("category"), v.cast("string").alias("key")) for k, v in kinds.items()])).alias("x")
    plain = written(df.select(marks).where("x.key IS NOT NULL").groupBy("x.category", "x.key").agg(F.count("*").alias("value")).select("category", "key", "value"), "plain-counts")
    rows = df.join(few(assigned.select(F.col("sample_id").alias("id"), "main_label", "subtopic_label", "min_level", "insertion_position", "variant_id")), "id", "left")
    rows = rows.join(few(sentences.select(F.col("subtopic").alias("subtopic_label"), "variant_id", "style")), ["subtopic_label", "variant_id"], "left")
    used = written(rows.where("min_level IS NOT NULL").select("main_label", "subtopic_label", "min_level", "insertion_position", "variant_id", "style"), "contaminated")
    own = {
        "main_subtopic_pairs": F.concat_ws("|", "main_label", "subtopic_label"), "insertion_position": F.col("insertion_position"),
        "sentence_usage": F.concat("subtopic_label", F.lit("|variant"), F.col("variant_id").cast("string")), "style_usage": F.col("style"),
    }
    twice = duplicates and written(duplicate_counts(contaminate(df, assigned, sentences, levels), "contamination_level"), "equal-texts")
    out = None
    for level in levels:
        hit = used.where(applies_at(F.lit(level), F.col("min_level")))
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("category"), v.alias("key")) for k, v in own.items()])).alias("x")
        counted = hit.select(each).where("x.key IS NOT NULL").groupBy("x.category", "x.key").agg(F.count("*").alias("value"))
        rate = hit.agg(F.count("*").alias("contaminated_count")).withColumn("contaminated_ratio", F.col("contaminated_count") / F.lit(max(total, 1))).select(F.col("contaminated_count").cast("double").alias("contaminated_count"), "contaminated_ratio")
        parts = [(plain, None), (counted, None), (rate, "contamination_rate")]
        if duplicates:
            same = twice.where(F.col("contamination_level") == level)
            twins = same.agg(*[F.coalesce(F.sum(F.when(F.col("match_type") == k, F.col("n"))), F.lit(0)).cast("double").alias(f"{k}_group_count") for k in ("exact", "normalized")])
            parts.append((twins, "duplicates"))
        if near_duplicates:
            made = contaminate(df, assigned, sentences, (level,))
            texts = written(df.drop("raw_text", "body_text").join(made.select("id", "raw_text", "body_text"), "id"), f"texts-{level}")
            summary = exact_summary(texts)
            parts.append((summary.select(*[F.col(c).cast("double").alias(c) for c in summary.columns]), "near_duplicates"))
        for part, category in parts:
            if category:
                part = part.unpivot([], part.columns, "key", "value").withColumn("category", F.lit(category))
            part = long(part, level)
            out = part if out is None else out.unionByName(part)
    return out


def usage_skew(assigned: DataFrame, factor: float = 2.5) -> DataFrame:
    """Sentences used more than factor times as often as an even use of their subtopic's would have it."""
    used = assigned.groupBy("subtopic_label", "variant_id").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("subtopic_label"))
    return used.withColumn("even", total / SENTENCES).where(F.col("n") > factor * F.col("even"))


def review_flags(assigned: DataFrame, records: DataFrame, sentences: DataFrame) -> DataFrame:
    """(sample_id, flags): terse sentences in hard or ambiguous mails, and mails with more than one intent."""
    rows = must_match(assigned, records.select(F.col("id").alias("sample_id"), "multi_intent"), "sample_id")
    rows = rows.join(few(sentences.select(F.col("subtopic").alias("subtopic_label"), "variant_id", "style")), ["subtopic_label", "variant_id"], "left")
    terse = F.when(F.col("style").isin("fact", "concise") & F.col("difficulty").isin("hard", "ambiguous"), "terse_in_hard")
    return rows.select("sample_id", F.concat_ws("|", terse, F.when(F.col("multi_intent"), "multi_intent")).alias("flags")).where("flags <> ''")


def transition_examples(oof: DataFrame, scores: DataFrame, assigned: DataFrame, baseline: str, level: str, n: int = 6) -> DataFrame:
    """Up to n contaminated samples of each cell with what happened to them: flips from right to wrong first, then by
    how much the true class lost against the predicted one, then by sample.

    scores: condition, model, contamination_level, sample_id, label, score."""
    keys = ["condition", "model", "sample_id"]
    cols = ["true_label", "predicted_label"]
    side = lambda lv, s: oof.where(F.col("contamination_level") == lv).select(*keys, *[F.col(c).alias(f"{c}{s}") for c in cols])
    hit = assigned.where(applies_at(F.lit(level), F.col("min_level"))).select("sample_id", "subtopic_label")
    both = side(level, "").join(side(baseline, "_before"), keys).join(hit, "sample_id")
    at = scores.where(F.col("contamination_level") == level)
    of = lambda label, name: at.select(*keys, F.col("label").alias(label), F.col("score").alias(name))
    scored = both.join(of("true_label", "true_score"), [*keys, "true_label"]).join(of("predicted_label", "predicted_score"), [*keys, "predicted_label"])
    flip = ((F.col("true_label") == F.col("predicted_label_before")) & (F.col("true_label") != F.col("predicted_label"))).cast("int")
    w = Window.partitionBy("condition", "model").orderBy(flip.desc(), (F.col("predicted_score") - F.col("true_score")).desc(), "sample_id")
    return scored.withColumn("flipped", flip == 1).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("true_label_before")
