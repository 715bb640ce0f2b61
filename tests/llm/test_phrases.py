"""Phrase collocations against a plain count and against the query's SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from corpusloom.llm import phrases as Q
from tests.llm import cases


def brute(rows, longest=3, least=10, top=2000):
    """rows (lang, text) to the query's rows, one phrase at a time."""
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    for lang, counts in f.items():
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * c >= 50 * a and inside(q) for q, c in candidates.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def awkward():
    base = "the Big cat sat, on the\tbig mat. the big cat sat! New York City; new york city\x0bnew york"
    return [("en", base)] * 6 + [("en", base.upper())] * 5 + [(None, "a a a a a a a a a a a a b")] * 3 + [("und", "a a\x85b a a\xa0b")] * 11 + [("de", "ß Ä ä Ä ä " * 9), ("de", None), ("de", ""), ("de", " \t., ;"), ("fr", "über " * 4000 + "x")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 0, 9, "p", 7) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, n int, phrase string, size int")


def test_equals_brute_force_and_sql(spark, tmp_path):
    rows = awkward()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = Q.op12_phrase_collocations(spark, str(tmp_path))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(map(tuple, out.collect()))
    assert got == brute(rows) and len({r[0] for r in got}) == 4
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(db.execute(Q.SQL["op12_phrase_collocations"]).fetchall()) == got


def test_hostile_documents_and_top(spark):
    docs = cases.documents(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()] * 2
    doubled = docs.unionByName(docs)
    assert sorted(map(tuple, Q.collocations(doubled, least=2).collect())) == brute(rows, least=2)
    assert sorted(map(tuple, Q.collocations(doubled, least=2, top=3).collect())) == brute(rows, least=2, top=3)
    assert sorted(map(tuple, Q.collocations(doubled, longest=4, least=4).collect())) == brute(rows, longest=4, least=4)
    assert Q.collocations(cases.empty(spark)).count() == 0


def test_flushes_and_a_bucket_that_spills_change_nothing(spark, monkeypatch):
    rows = awkward() + [("en", cases.words(400, s)) for s in range(30)]
    monkeypatch.setattr(Q, "FLUSH_WORDS", 50)
    monkeypatch.setattr(Q, "FILTER_BITS", 64)  # lets almost everything through
    assert sorted(map(tuple, Q.collocations(frame(spark, rows)).collect())) == brute(rows)


def test_filter_has_what_was_added_and_little_else():
    f = Q.FrequentFilter(1 << 16)
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64)
    f.add(hashes[:1000])
    assert f.has(hashes[:1000]).all() and f.has(hashes[1000:]).mean() < 0.01


def test_scores_beyond_64_bits(spark):
    counts = [(10**14, 10**15, 10**15 + 7), (3 * 10**15, 3 * 10**15, 3 * 10**15), (999_999_999_999, 10**12, 10**15)]
    df = spark.createDataFrame(counts, "a long, l long, r long").selectExpr("a", "l", "r", "cast(a as decimal(18,0)) a_", "cast(l as decimal(18,0)) l_", "cast(r as decimal(18,0)) r_")
    got = {r["a"]: r["score"] for r in df.selectExpr("*", f"{Q.SCORE} AS score").collect()}
    assert got == {a: 10**6 * a * a // (left * right) for a, left, right in counts}


def test_spill_folder_is_in_the_shared_folder(tmp_path):
    assert Q._spill_folder(f"file://{tmp_path}").startswith(f"{tmp_path}/corpusloom/spill-")


@pytest.mark.parametrize("rows", [[("en", "x y " * 30)], [("en", "one")], [(None, None)]])
def test_small_tables(spark, rows):
    assert sorted(map(tuple, Q.collocations(frame(spark, rows)).collect())) == brute(rows)
