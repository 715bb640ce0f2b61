import re
from collections import Counter

from corpusloom.llm import license_scan, quality, url_filter

from .cases import documents, empty, texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n, repeated = len(w), len(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeated, n < 50 or 100 * repeated > 50 * n)


def test_quality_counts(spark, tmp_path):
    docs = documents(spark)
    extra = spark.createDataFrame([(50, "a b c d\na b c d\n#|<x>\n#|<x>\n" + words(60, 9), "en", "s", 1, None, None, None, None, None), (51, "a b", None, None, None, None, None, None, None, None), (52, "a b c a b c", None, None, None, None, None, None, None, None)], docs.schema)
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.op6_quality_rules(spark, str(tmp_path)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = sorted([(r["doc_id"], *counts(r["text"])) for r in docs.unionByName(extra).collect()], key=str)
    assert sorted([(r["doc_id"], *[r[n] for n in names]) for r in got], key=str) == want
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_bad_hosts_take_their_documents_with_them(spark):
    good, bad = words(60, 1), "x y"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(400)] + [(1000 + i, bad if i % 20 else good, "farm") for i in range(400)] + [(2000, good, "new"), (2001, good, None), (2002, None, "gone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hosts = {r["host"]: r for r in quality.host_verdicts(docs.select("source", quality.base_failed().alias("base_failed"))).collect()}
    assert hosts["farm"]["rejected"] and not hosts["fine"]["rejected"] and not hosts["new"]["rejected"]
    assert 0 < hosts["new"]["rate"] < 1  # shrunk
    kept = {r["doc_id"] for r in quality.quality_filter(docs).collect()}
    assert kept == {r[0] for r in rows if r[1] == good and r[2] != "farm"}
    assert quality.quality_filter(empty(spark)).collect() == []
    assert quality.quality_filter(documents(spark)).columns == documents(spark).columns


def judged(spark, urls):
    frame = spark.createDataFrame([(i, u, "t", "p", "h") for i, u in enumerate(urls)], "page_id long, url string, token string, pattern_verdict string, host string")
    return [r for r in url_filter.judge_urls(frame).orderBy("page_id").collect()]


def test_url_parts_and_host_rules(spark):
    urls = [None, "", "no scheme/x", "HTTP://WWW.Example.NET/en/A?x=1#y", "https://a.example.com/de/", "https://a.example.com/DE/", "https://notexample.com/de/x", "x://b.org/fr/1", "http://b.net", "http://b.net/?q", "http://h?q=://z/", "a://b://c/d"]
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in judged(spark, urls)]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.net", "/en/A", "example.net/en/", "allow"), ("a.example.com", "/de/", "example.com/de/", "block"),
        ("a.example.com", "/DE/", None, "allow"), ("notexample.com", "/de/x", None, "allow"), ("b.org", "/fr/1", "org/fr/", "allow"), ("b.net", "", None, "allow"), ("b.net", "/", "net/", "block"), ("h", "", None, "allow"), ("b:", "//c/d", None, "allow"),
    ]


def test_pattern_rules_against_all_regexes(spark):
    urls = ["http://spam-farm.example.com/a", "http://www.spam-farm.de/", "http://notspam-farm.com/", "http://x.com/adserver/1", "http://x.com/adserver/policy.html", "http://casino/", "http://casinos.com/", "http://free-cash-now.biz", "http://a.com/?sessionid=1", "http://a.com/?x&affiliate=2&click=3"] * 3
    rules = [url_filter.PatternRule(*r) for r in url_filter.PATTERN_RULES]
    want = []
    for u in urls:
        hits = {r.verdict for r in rules if re.search(r.regex, u.lower())}
        want.append("allow" if "allow" in hits or not hits else "block")
    assert [r["verdict"] for r in judged(spark, urls)] == want and {"allow", "block"} == set(want)
    assert judged(spark, []) == []


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("http://farm.com/spam",), ("http://spam.com/",), ("http://spam.org",)], "url string")
    index = {r["regex"]: r["token"] for r in url_filter.rule_index(urls, [url_filter.PatternRule("||spam-farm.", "block")]).collect()}
    assert set(index.values()) == {"farm"}


def plain_license(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    places = [(i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark):
    mit = license_scan.TEMPLATES[0][1].split()
    mit[6], mit[14] = "without", "persons"
    more = ["MIT License", "x mit   license, Apache-License; general public license", "license mit", " ".join(mit), words(30, 1) + " Licensed under CC BY-NC 4.0. " + words(30, 2), "license", "The MIT\nLICENSE é mit license"]
    docs = spark.createDataFrame([(i, t, "label") for i, t in enumerate([*texts(), *more])] + [(17, "MIT License", "label"), (None, "apache license", None)], "doc_id long, text string, label string")
    rows = docs.collect()
    got = license_scan.scan_licenses(docs).collect()
    pick = lambda r: (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
    assert sorted(map(pick, got), key=str) == sorted([(r["doc_id"], *plain_license(r["text"])) for r in rows], key=str)
    by = {r["doc_id"]: r for r in got}
    assert "cc-by-nc" in by[21]["labels"] and by[5]["labels"] == "" and by[5]["score"] == 0
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert license_scan.scan_licenses(empty(spark)).collect() == []


def test_near_license_texts_are_found(spark):
    for label, text in license_scan.TEMPLATES:
        w = text.split()
        if len(w) > 20:
            w.insert(len(w) // 2, "really")
        doc = words(40, 3) + " " + " ".join(w) + " " + words(40, 4)
        found = license_scan.scan_licenses(spark.createDataFrame([(1, doc)], "doc_id long, text string")).first()
        assert label in found["labels"].split(",")


def test_many_host_rules_are_joined_and_rules_without_tokens_are_matched(spark, monkeypatch):
    rules = [(f"{h}/{p}", v) for h, p, v in (("net", "", "block"), ("example.net", "en/", "allow"), ("example.com", "de/", "block"), ("org", "fr/", "allow"), ("a.example.net", "en/x", "block"))]
    urls = [None, "", "no scheme", "http://x.NET/", "https://a.b.example.net/en/1?q", "https://a.example.net/en/xy", "ftp://example.com/de/", "ftp://example.com/en/", "http://org/fr/a", "http://notnet/", "http://net", "s://deep.org/fr/", "http://z.de/zzz~1", "http://z.de/zz!"]
    frame = spark.createDataFrame([(i, u, 1, 2, 3, 4, 5) for i, u in enumerate(urls)], "page_id int, url string, host_rule int, __rule int, __url int, matched_url int, pattern_verdict int")
    patterns = (("*zzz*", "block"), ("~", "allow"), ("||casino^", "block"))
    answers = []
    for limit in (64, 0):
        monkeypatch.setattr(url_filter, "EXPRESSION_RULES", limit)
        got = url_filter.judge_urls(frame, rules, patterns)
        assert set(frame.columns) <= set(got.columns)
        answers.append({r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()})
    assert answers[0] == answers[1]
    assert [answers[0][i] for i in range(3, 14)] == [("net/", "block"), ("example.net/en/", "allow"), ("a.example.net/en/x", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"), (None, "allow")]
    assert url_filter.judge_urls(frame, [], (("*zzz*", "block"),)).where("page_id = 12").first()["verdict"] == "block"


def test_rules_leave_columns_of_like_names(spark):
    docs = spark.createDataFrame([(1, words(60, 1), "s", 5, 6, 7, 8)], "doc_id long, text string, source string, __c int, counts int, failed int, rejected_host int")
    assert set(docs.columns) <= set(quality.with_rules(docs).columns)
    assert [tuple(r) for r in quality.quality_filter(docs).collect()] == [tuple(r) for r in docs.collect()]
