"""Segmentation against an exhaustive search, and the hashed sink and level statistics against plain versions."""

import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import lattice as S
from corpusloom.operators import contamination as C
from corpusloom.sources import tables as T

WORDS = [
    ("東京", "東京", "東京", "noun", 3000, None), ("京都", "京都", "京都", "noun", 3000, None), ("東", "東", "東", "noun", 4000, None), ("都", "都", "都", "suffix", 2500, None), ("東京都", "東京都", "東京都", "noun", 5000, "2,1"),
    ("に", "に", "に", "particle", 500, None), ("行か", "行く", "行く", "verb", 2000, None), ("ない", "無い", "ない", "auxiliary", 800, None), ("な", "な", "だ", "auxiliary", 900, None), ("いない", "居ない", "いない", "verb", 2600, None),
    ("外国人参政権", "外国人参政権", "外国人参政権", "noun", 6000, "2,1,3"), ("外国", "外国", "外国", "noun", 3000, None), ("人", "人", "人", "noun", 2800, None), ("人参", "人参", "人参", "noun", 3000, None), ("参政権", "参政権", "参政権", "noun", 3500, None),
]


def lattice():
    return S.Lattice([S.Word(*w[:5], tuple(map(int, w[5].split(","))) if w[5] else ()) for w in WORDS])


def cheapest(made, text):
    """The least (cost, words) over all paths."""
    @cache
    def rest(at):
        if at == len(text):
            return (0, 0)
        return min(tuple(x + y for x, y in zip((w.cost, 1), rest(at + len(w.surface)))) for w in made.starting(text, at))
    return rest(0)


def test_equals_exhaustive_search():
    made, r = lattice(), random.Random(3)
    pieces = [w[0] for w in WORDS] + ["カメラ", "abc", "12", " ", "、", "ん"]
    for _ in range(200):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(9)))
        found = made.words(text)
        assert "".join(w.surface for w in found) == text and (sum(w.cost for w in found), len(found)) == cheapest(made, text)
    assert [w.surface for w in made.words("東京都に行かない")] == ["東京都", "に", "行か", "ない"]
    assert sum(len(w.surface) for w in made.words("ん" * 20_000)) == 20_000


def test_modes_forms_and_parts_of_speech(spark):
    words = spark.createDataFrame(WORDS, "surface string, normalized string, dictionary string, pos string, cost int, short string")
    df = spark.createDataFrame([(1, "外国人参政権 東京都に行かない"), (2, None), (3, ""), (4, "  \n")], "id long, text string")
    out = lambda mode="C", form="surface", **k: {r["id"]: r["t"] for r in df.select("id", S.token_forms(S.segment(F.col("text"), words, mode, **k), form).alias("t")).collect()}
    assert out() == {1: ["外国人参政権", "東京都", "に", "行か", "ない"], 2: None, 3: [], 4: []}
    assert out("A")[1] == ["外国", "人", "参政権", "東京", "都", "に", "行か", "ない"]
    assert out("B")[1] == ["外国", "人参政権", "東京", "都", "に", "行か", "ない"]
    assert out(form="dictionary")[1][-2:] == ["行く", "ない"] and out(form="normalized")[1][-1] == "無い"
    assert out(remove_pos=("particle", "auxiliary"))[1] == ["外国人参政権", "東京都", "行か"]
    assert out(remove_pos=("particle", "auxiliary"), keep=("ない",))[1][-1] == "ない"
    with pytest.raises(ValueError):
        S.segment(F.col("text"), words, "D")


def test_hashed_sink_names_a_damaged_part(spark, tmp_path):
    rows = [(i, None if i == 7 else f"täxt {i}  " + "x" * (i % 50)) for i in range(300)] + [(5, "again")]
    df, path = spark.createDataFrame(rows, "id long, text string"), f"{tmp_path}/t"
    digest = T.write_hashed_jsonl(df.repartition(7), path, part_bytes=2000)
    parts = sorted((tmp_path / "t" / "data").glob("part-*"))
    assert len(parts) > 5 and T.damaged_parts(spark, path) == []
    lines = "".join(p.read_text("utf-8") for p in parts).split("\n")
    assert len(lines) == 302 and lines[0].startswith('{"id":0,') and '"text":null' in lines[8]
    back = T.read_hashed_jsonl(spark, path, digest, "id bigint, text string")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert T.write_hashed_jsonl(df, f"{tmp_path}/u", part_bytes=2000) == digest  # the same rows, the same digest
    with pytest.raises(ValueError, match="approved"):
        T.read_hashed_jsonl(spark, path, "0" * 64)
    parts[2].write_bytes(parts[2].read_bytes().replace(b"x", b"y", 1))
    (parts[2].parent / f".{parts[2].name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match=parts[2].name):
        T.read_hashed_jsonl(spark, path, digest)
    empty = T.write_hashed_jsonl(df.limit(0), f"{tmp_path}/e")
    assert T.read_hashed_jsonl(spark, f"{tmp_path}/e", empty, "id bigint, text string").count() == 0


def test_level_statistics(spark):
    texts = {i: f"text {i % 10} with some words that are shared by all of them {'and more' * (i % 3)}" for i in range(20)}
    df = spark.createDataFrame([(i, "ab"[i % 2], f"g{i % 3}", "easy", t, t) for i, t in texts.items()], "id long, label string, template_group string, difficulty string, raw_text string, body_text string")
    assigned = spark.createDataFrame([(0, "a", "b", "C10", "end", 1), (3, "b", "a", "C30", "early", 0)], "sample_id long, main_label string, subtopic_label string, min_level string, insertion_position string, variant_id int")
    sentences = spark.createDataFrame([(x, v, "fact", f"sentence {v} about {x}") for x in "ab" for v in range(2)], "subtopic string, variant_id int, style string, text string")
    got = {(r["level"], r["category"], r["key"]): r["value"] for r in C.level_statistics(df, assigned, sentences).collect()}
    assert {k[1] for k in got} == set(C.STATISTICS)
    assert got["C0", "total_count", "total_count"] == 20 and got["C30", "class_counts", "a"] == 10
    assert [got[x, "contamination_rate", "contaminated_count"] for x in C.LEVELS] == [0, 1, 1, 2] and got["C30", "contamination_rate", "contaminated_ratio"] == 0.1
    assert got["C30", "main_subtopic_pairs", "b|a"] == 1 and ("C20", "main_subtopic_pairs", "b|a") not in got and got["C20", "sentence_usage", "b|variant1"] == 1 and got["C30", "style_usage", "fact"] == 2
    changed = {0: texts[0] + "\n\nsentence 1 about b", 3: texts[3] + "\n\nsentence 0 about a"}
    for level, ids in (("C0", ()), ("C10", (0,)), ("C30", (0, 3))):
        own = [changed[i] if i in ids else t for i, t in texts.items()]
        same = sum(own.count(t) > 1 for t in set(own))
        assert got[level, "duplicates", "exact_group_count"] in (same, 2 * same)  # raw and body texts are groups of their own
        sets = [frozenset(tuple(w[j : j + 3]) for j in range(len(w) - 2)) for w in (t.split() for t in own)]
        assert got[level, "near_duplicates", "total_pairs"] == sum(len(a & b) >= 0.5 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
