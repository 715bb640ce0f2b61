import hashlib

import numpy as np
import pytest

from corpusloom.llm import chat, decontamination, toxicity

from .cases import documents, empty, words

NASTY = ["", "</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<|end|>", "<|turn:user|>", "[INST][/INST]\\[", "<<SYS>>x<</SYS>>", "a\n\\n<\\|", "<</s>", "[[INST]"]


@pytest.mark.parametrize("text", NASTY)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|", "<<SYS>>"))
    for role in ("user", "assistant", text):
        segment, start, length, _ = chat.format_turn(role, [{"type": "text", "text": text}], True, True)
        assert chat.parse_segment(segment) == (role, text)
        assert chat.unescape(segment[start : start + length]) == (text if role == "assistant" else "")


def test_typed_parts():
    parts = [{"type": "text", "text": "see <|image:1|>"}, {"type": "image", "ref": "a.png"}, {"type": "audio", "ref": "b.wav", "tokens": 7}, {"type": "image", "ref": "c.png"}, {"type": "document", "ref": "d.pdf"}]
    segment, _, _, attached = chat.format_turn("user", parts, True, False)
    assert segment == "<s><|turn:user|>see <\\|image:1|><|image:1|><|audio:1|><|image:2|><|document:1|><|end|>"
    assert [(a["ordinal"], a["type"], a["ref"], a["tokens"]) for a in attached] == [(1, "image", "a.png", 256), (1, "audio", "b.wav", 7), (2, "image", "c.png", 256), (1, "document", "d.pdf", 512)]
    odd = [None, {"type": "video", "ref": "e"}, {"type": None, "text": None}, {"type": "unknown", "tokens": 3}, {"text": "<|other:1|> \\ end"}]
    segment, _, _, others = chat.format_turn("user", odd, True, True)
    assert segment == "<s><|turn:user|><|other:1|><|other:2|><\\|other:1|> \\\\ end<|end|></s>"
    assert [(a["type"], a["ref"], a["tokens"]) for a in others] == [("video", "e", 0), ("unknown", None, 3)]
    # texts that look like placeholders and placeholders come back as what they are
    back = chat.parse_parts(chat.format_turn("user", parts, True, False)[0], attached)
    assert back[0] == "user" and [(p["type"], p["text"] or p["ref"]) for p in back[1]] == [("text", "see <|image:1|>"), ("image", "a.png"), ("audio", "b.wav"), ("image", "c.png"), ("document", "d.pdf")]
    assert [(p["type"], p["text"]) for p in chat.parse_parts(segment, others)[1]] == [("video", None), ("unknown", None), ("text", "<|other:1|> \\ end")]


def test_typed_parts_in_spark(spark):
    """A column of parts, with null arrays, null parts and unknown types."""
    parts = [("text", "a <|image:1|>", None, None), ("image", None, "x.png", None), None, ("video", None, "v", 9)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)]), (2, 0, "assistant", None), (3, 0, "user", [])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_conversations(frame, "content").collect()}
    assert len(got) == 4 and got[2, 0]["segment"] == "<s><|turn:assistant|><|end|></s>" and got[2, 0]["loss_length"] == 0
    role, back = chat.parse_parts(got[1, 0]["segment"], [a.asDict() for a in got[1, 0]["attachments"]])
    assert role == "user" and [(p["type"], p["text"] or p["ref"], p["tokens"]) for p in back] == [("text", "a <|image:1|>", None), ("image", "x.png", 256), ("video", "v", 9)]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "hi"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "user", "lost"), (3, 0, "assistant", NASTY[7]), (3, 0, "assistant", NASTY[7]), (3, 2, "assistant", "long " * 30_000)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: r for r in chat.read_conversations(chat.format_conversations(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in (1, 2, 3, None):
        turns = sorted([(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        own = "".join(t for _, role, t in turns if role == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(own), sha(own))
    assert got[2]["formatted_chars"] == len("<s><|turn:|>x<|end|></s>")
    assert chat.read_conversations(chat.format_conversations(frame.limit(0))).collect() == []


def test_masks_find_every_window_with_two_substitutions():
    from itertools import combinations

    for gone in combinations(range(13), 2):
        assert any(all(at + i not in gone for i in m) for mask, m in zip(decontamination.MASKS, decontamination._offsets) for at in range(14 - len(mask)))


def test_best_overlap():
    doc, item = np.arange(100), np.arange(20, 60)
    assert decontamination.best_overlap(doc, item, 20) == (0, 40, 40)
    broken = doc.copy()
    broken[[30, 45]] = -1
    assert decontamination.best_overlap(broken, item, 20) == (0, 40, 38)
    assert decontamination.best_overlap(doc, item, 500) == (0, 0, 0)
    assert decontamination.best_overlap(doc, item + 1000, 20)[1] == 0
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 25))
        same = rng.random(n) < 0.7
        spans = [(j - i, same[i:j].sum()) for i in range(n) for j in range(i + 1, n + 1) if same[i] and same[j - 1] and same[i:j].mean() >= 0.8 - 1e-9]
        got = decontamination.best_overlap(np.where(same, np.arange(n), -1), np.arange(n), 0)
        assert got[1] <= max((x[0] for x in spans), default=0) and (not got[1] or got[2] >= 0.8 * got[1] - 1e-9)
        assert got[1] >= max((x[0] for x in spans), default=0) - 2  # unequal ends that were cut


def test_overlap_is_the_longest_after_trimming():
    for same in ([1] * 12 + [0] * 12 + [1] * 4 + [0, 1, 0] + [1] * 6, [1] * 6 + [0, 1, 0] + [1] * 4 + [0] * 12 + [1] * 12):
        assert decontamination.best_overlap(np.where(same, np.arange(len(same)), -1), np.arange(len(same)), 0)[1:] == (13, 11)
    rng = np.random.default_rng(10)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        same = rng.random(n) < 0.7
        most = max((j - i for i in range(n) for j in range(i + 1, n + 1) if same[i] and same[j - 1] and same[i:j].sum() * 5 >= 4 * (j - i)), default=0)
        assert decontamination.best_overlap(np.where(same, np.arange(n), -1), np.arange(n), 0)[1] == most


def test_short_overlap():
    rng = np.random.default_rng(11)
    for _ in range(500):
        n = int(rng.integers(1, 13))
        same = rng.random(n) < 0.7
        most = max((j - i for i in range(n) for j in range(i + 1, n + 1) if same[i] and same[j - 1] and same[i:j].sum() >= j - i - 1), default=0)
        at, words_, equal = decontamination.short_overlap(np.where(same, np.arange(n), -1), np.arange(n), 0)
        assert words_ == most and equal == same[at : at + words_].sum() and (not most or same[at] and same[at + words_ - 1])


def plain_words(text):
    out = [""]
    for c in text or "":
        if "A" <= c <= "Z":
            out[-1] += chr(ord(c) + 32)
        elif c in "0123456789" or "a" <= c <= "z" or ord(c) > 127:
            out[-1] += c
        else:
            out.append("")
    return [w for w in out if w]


def plain_overlap(dw, iw):
    """(doc place, item place, words, equal words) of the overlap that counts, by all stretches of all diagonals."""
    found, n = [], len(iw)
    if n < 4:
        return None
    for g in range(-n, len(dw)):
        own = []
        for i in range(n):
            for j in range(i + 1, n + 1):
                if i + g < 0 or j + g > len(dw) or iw[i] != dw[i + g] or iw[j - 1] != dw[j - 1 + g]:
                    continue
                length, equal = j - i, sum(iw[k] == dw[k + g] for k in range(i, j))
                if n >= 13:
                    good = length >= 13 and equal * 5 >= length * 4
                elif n >= 7:
                    good = length >= 7 and length * 5 >= n * 4 and equal >= length - 1
                else:
                    good = equal == length == n
                if good:
                    own.append((length, -i, equal))
        if own:
            length, i, equal = max(own)
            found.append((equal, length, -(g - i), i))
    if found:
        equal, length, place, i = max(found)
        return (-place, -i, length, equal)
    return None


def test_contaminated_documents(spark):
    items = [(1, words(30, 100)), (2, words(14, 101)), (3, words(8, 102)), (4, "far too short"), (5, None), (1, words(30, 100)), (6, "one two three five"), (7, words(11, 103)), (None, words(20, 104))]
    passage = words(30, 100).split()
    touched = list(passage)
    touched[5], touched[17] = "other", "words"
    eight = words(8, 102).split()
    eight[3] = "else"
    eleven = words(11, 103).split()
    docs = [
        (1, words(200, 1)), (2, words(50, 2) + " " + " ".join(passage).upper() + ". " + words(50, 3)), (3, " ".join(touched)), (4, words(20, 4) + "\n" + words(14, 101)), (5, " ".join(passage[:9])),
        (6, None), (7, ""), (8, words(3000, 5) + " " + words(8, 102) + " " + words(3000, 6)), (2, words(10, 7)), (9, " ".join(passage[3:20])), (None, words(40, 8)), (None, " ".join(passage)), (None, None),
        (10, "so one, two THREE five is"), (11, "one two three, and five"), (12, words(9, 9) + " " + " ".join(eight)), (13, " ".join(eleven[:5] + ["x"] + eleven[6:]) + " far too short"), (14, words(20, 104)), (3, " ".join(touched)),
    ]
    d = spark.createDataFrame([(*x, "e", 1, 2, 3) for x in docs], "doc_id long, text string, words string, __id int, own_hash int, found_id int")
    b = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, doc string")
    got = [tuple(r) for r in decontamination.contaminated_spans(d, b).collect()]
    want = {(i, j, *o) for i, t in docs for j, u in items if j is not None and (o := plain_overlap(plain_words(t), plain_words(u)))}
    assert len(got) == len(set(got)) and set(got) == want and {x[0] for x in got} == {2, 3, 4, 8, 9, 10, 12, 13, None}
    left = decontamination.decontaminate(d, b)
    assert left.columns == d.columns
    assert sorted([(r["doc_id"], r["text"]) for r in left.collect()], key=str) == sorted([x for x in docs if not any(x[0] == g[0] for g in got) or x in [(2, docs[8][1]), (None, docs[10][1]), (None, None)]], key=str)
    assert decontamination.contaminated_spans(empty(spark), b).collect() == []
    assert decontamination.contaminated_spans(d, b.limit(0)).collect() == [] and decontamination.decontaminate(d, b.limit(0)).count() == len(docs)


def test_seeds_find_the_overlaps_that_count():
    """Short items: every overlap with its one substitution. Longer ones: at 20 % substitutions the share found."""
    from itertools import combinations

    meets = lambda n, gone: any(all(at + i not in gone for i in decontamination._offsets[m]) for m in decontamination.masks_of(n) for at in range(n - len(decontamination._ALL[m]) + 1))
    for n in range(4, 13):
        for gone in combinations(range(n), 1 if n >= 7 else 0):
            assert meets(n, gone)
    for length in range(7, 13):  # also where only part of the item is there
        part = decontamination.needed_words(length)
        assert all(any(all(at + i != g for i in decontamination._offsets[3]) for at in range(part - 4)) for g in range(part))
    rng = np.random.default_rng(5)
    for n in (13, 15, 20, 30, 45):
        trials = [set(rng.choice(np.arange(1, n - 1), n // 5, replace=False).tolist()) for _ in range(2000)]
        assert np.mean([meets(n, g) for g in trials]) >= 0.9, n


def test_one_word_many_times_is_one_row_of_a_region(spark):
    d = spark.createDataFrame([(1, "same " * 3000)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "same " * 30)], "item_id long, text string")
    assert [tuple(r) for r in decontamination.contaminated_spans(d, b).collect()] == [(1, 1, 0, 0, 30, 30)]


def test_gradients():
    net = toxicity.Network.new({b"a": 1, b"bc": 2, b"d": 3}, 1)
    rng = np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) + 0.05 * rng.normal(size=v.shape) for k, v in net.p.items()}
    ids, grams, counts = np.array([1, 2, 0, 3]), np.array([5, 6, 7, 8, 9, 5]), np.array([2, 1, 2, 1])
    index, mask = rng.integers(0, 4, (3, 6)), np.ones((3, 6))
    mask[1, 4:] = 0
    y, keep = np.array([1.0, 0, 1]), np.array([1.0, 1, 0, 0])
    for doubt in (0.0, 0.5):
        run = lambda: toxicity._gradients(net, ids, grams, counts, index, mask, y, keep, doubt)
        _, grad = run()
        for name, at in (("forth", (1, 5)), ("back", (3, 20)), ("attend", (4,)), ("weigh", (9,)), ("bias", (0,)), ("in_word", (2, 7)), ("in_char", (3, 30)), ("word", (2, 3)), ("char", (5, 1)), ("in_bias", (11,))):
            old = net.p[name][at]
            losses = []
            for step in (1e-3, -1e-3):
                net.p[name][at] = old + step
                losses.append(run()[0])
            net.p[name][at] = old
            if isinstance(grad[name], tuple):  # rows of an embedding
                places, sums = grad[name]
                got = sums[np.flatnonzero(places == at[0])[0], at[1]]
            else:
                got = grad[name][at]
            assert abs((losses[0] - losses[1]) / 2e-3 - got) < 2e-3 * max(1, abs(got)), name


def plain_score(net, text):
    """The score of a text by plain loops over its windows, words and units."""
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.HIDDEN
    words = toxicity.time_steps(text.encode())
    top = p["bias"][0]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def row(word):
        letters = [ord(c) for c in "<" + word.decode() + ">"]
        total, n = np.zeros(toxicity.CHAR_DIM), 0
        for size in (3, 4, 5):
            for i in range(len(letters) - size + 1):
                x = 0
                for c in letters[i : i + size]:
                    x = (x * 0x100000001B3 + c) % 2**64
                x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 % 2**64
                total += p["char"][(x >> 32) % toxicity.CHAR_BUCKETS]
                n += 1
        own = p["word"][net.vocabulary[word]] if word in net.vocabulary else np.zeros(toxicity.WORD_DIM)
        return own @ p["in_word"] + total / n**0.5 @ p["in_char"] + p["in_bias"]

    rows = [row(w) for w in words]
    starts = {max(0, len(words) - 32), *range(0, max(0, len(words) - 32), 16)} if words else set()
    logits = []
    for start in starts:
        window = rows[start : start + 32]
        states = [np.zeros(2 * h) for _ in window]
        for side, name in enumerate(("forth", "back")):
            s = np.zeros(h)
            for t in range(len(window)) if side == 0 else reversed(range(len(window))):
                x, g = window[t][3 * h * side : 3 * h * (side + 1)], s @ p[name]
                z, r = sigmoid(x[:h] + g[:h]), sigmoid(x[h : 2 * h] + g[h : 2 * h])
                n = np.tanh(x[2 * h :] + r * g[2 * h :])
                s = z * s + (1 - z) * n
                states[t][h * side : h * (side + 1)] = s
        share = np.exp([x @ p["attend"] for x in states])
        logits.append(sum(a * (x @ p["weigh"]) for a, x in zip(share / share.sum(), states)) + p["bias"][0])
    return sigmoid(max(logits, default=top))


def labelled(n, seed):
    rows = []
    for i in range(n):
        w = words(120, seed * 10_000 + i).split()
        toxic = i % 5 == 0
        if toxic:
            w[i % 100] = w[(i + 40) % 100] = ("dreckig", "blöd")[i % 2]
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_learns_and_scores_all_windows(spark):
    train = labelled(400, 1)
    net = toxicity.train([t.encode() for _, t, _ in train], [y for _, _, y in train])
    test = labelled(200, 2)
    frame = spark.createDataFrame([(i, t, "x") for i, t, _ in test] + [(900, None, "x"), (901, "", "x"), (902, words(8000, 77) + " Dreckig, " + words(3000, 78), "x"), (None, "a", "x")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in toxicity.score_documents(frame, net).collect()}
    wrong = [i for i, _, y in test if got[i]["predicted"] != y]
    assert len(wrong) <= 10
    assert got[902]["predicted"] == 1 and got[900]["score"] == got[901]["score"] < 0.3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    scorer = toxicity.Scorer(net)
    some = [t for _, t, _ in test[:20]] + ["", words(5, 1), words(32, 1), words(33, 1), words(700, 2), "ä" * 150 + " a"]
    assert np.allclose(scorer.texts([toxicity.time_steps(t.encode()) for t in some]), [plain_score(net, t) for t in some], atol=1e-5)
    long = words(9000, 77).split()
    long[7000] = "dreckig"
    whole = scorer.worst([[w.encode() for w in long]])
    toxicity_chunk, toxicity.CHUNK_WORDS = toxicity.CHUNK_WORDS, 64  # windows are the same however a text is looked up
    try:
        assert whole[0] == scorer.worst([[w.encode() for w in long]])[0] and whole[1] == scorer.worst([[w.encode() for w in long]])[1]
    finally:
        toxicity.CHUNK_WORDS = toxicity_chunk


def test_toxicity_on_held_out_documents():
    import zlib

    import duckdb

    root = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT d.doc_id, coalesce(text, ''), toxic FROM '{root}/documents.parquet' d JOIN '{root}/labels.parquet' l USING (doc_id) ORDER BY 1").fetchall()
    part = lambda out: [r for r in rows if (zlib.crc32(str(r[0]).encode()) % 4 == 2) == out]
    net = toxicity.train([r[1].encode() for r in part(False)], [r[2] for r in part(False)])
    p = toxicity.Scorer(net).texts([toxicity.time_steps(r[1].encode()) for r in part(True)])
    ones, zeros = (p[[r[2] == y for r in part(True)]] for y in (1, 0))
    auc = (ones[:, None] > zeros).mean() + (ones[:, None] == zeros).mean() / 2
    # the least of three inner folds of the training rows, less a hundredth: 0.956, 0.908, 0.985
    assert auc >= 0.946 and (ones >= 0.3).mean() >= 0.898 and (zeros < 0.3).mean() >= 0.975
    print("held out:", auc, (ones >= 0.3).mean(), (zeros < 0.3).mean())


def test_every_character_of_a_glued_text_is_scored():
    import random

    train = labelled(400, 1)
    net = toxicity.train([t.encode() for _, t, _ in train], [y for _, _, y in train])
    scorer, r = toxicity.Scorer(net), random.Random(3)
    glued = "".join(chr(0x4E00 + r.randrange(500)) for _ in range(2500))
    for at in (70, 1200, 2490):
        changed = glued[:at] + "\u9fa0\u9fa1\u9fa2" + glued[at + 3 :]
        assert len(toxicity.time_steps(glued.encode())) > toxicity.WINDOW
        assert plain_score(net, glued[at - 40 : at + 40]) != plain_score(net, changed[at - 40 : at + 40])
    for text in ("x" * 64, "x" * 65, "漢字" * 33, "a b " + glued):
        steps = [s.decode() for s in toxicity.time_steps(text.encode())]
        grams = {g for s in steps for g in (s[i : i + 3] for i in range(len(s) - 2))}
        assert all(len(s) <= 64 for s in steps) and {w[i : i + 3] for w in text.split() for i in range(len(w) - 2)} <= grams


def test_training_rows_are_never_held_out(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, 1, i % 2, "x") for i in range(20)] + [(3, 0, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    import zlib

    rows = toxicity.training_sample(docs, labels)
    free = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert {t.decode() for t, _ in rows} == {texts[i] for i in free if i in texts}
    assert toxicity.training_sample(empty(spark), labels) == []
    sizes = [len(t) for t, _ in toxicity.training_sample(docs, labels, size=2000)]
    assert sizes and sum(sizes) <= 2000
    net = toxicity.train([], [])
    assert toxicity.score_documents(empty(spark), net).collect() == [] and len(toxicity.score_documents(docs, net).collect()) == docs.count()
