"""The three operators in DataFrame functions, against plain Python."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from peerlens.llm import chat, line_dedup, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_lines(rows, least):
    """Deletes every line in a run of at least `least` words that also occurs earlier; lines without words don't count."""
    out, seen_at = {}, {}
    docs = sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = {d: [(k, x) for k, x in enumerate(d[1].split("\n")) if WORD.search(x)] for d in docs}
    gone = defaultdict(set)
    for d in docs:
        own = lines[d]
        for b in range(len(own)):
            words = 0
            for e in range(b, len(own)):
                words += len(WORD.findall(own[e][1]))
                key = tuple(x for _, x in own[b : e + 1])
                if words >= least:
                    if key in seen_at and seen_at[key] < (docs.index(d), b):
                        gone[d].update(range(own[b][0], own[e][0] + 1))
                    seen_at.setdefault(key, (docs.index(d), b))
    for i, t in rows:
        kept = t if (i, t) not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[(i, t)])
        out[(i, t)] = (kept, len(gone[(i, t)]) if (i, t) in gone else 0)
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    pool = ["a b c", "d e", "f", "g h i j k l m n o p q r", "s t u v w", "", "x y z 1 2 3", "é ß"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for k in range(60)]
    rows += [(60, None), (61, ""), (3, rows[3][1]), (62, "\n\n"), (None, "g h i j k l m n o p q r\nnew line")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_lines(rows, line_dedup.MIN_WORDS)
    assert len(got) == len(rows)
    for r in got:
        kept, gone = want[(r.doc_id, r.text)]
        assert (r.text_kept, r.n_removed) == (kept, gone), r
        assert r.n_lines == (len(r.text.split("\n")) if r.text else 0)
    assert any(r.n_removed and "\n\n" in r.text for r in got)


@pytest.mark.parametrize("least", [1, 2, 4, 7, 10, 17])
def test_line_dedup_of_any_length(spark, least):
    """Other limits than 10 need other numbers of rounds."""
    rng = random.Random(least)
    pool = ["a", "b", "a b", "c d e", " ", "", "f\tg h", "i j k l m n o", "p\r", "q r\x0bs"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 40)))) for k in range(25)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least).collect()
    want = brute_lines(rows, least)
    for r in got:
        assert (r.text_kept, r.n_removed) == want[(r.doc_id, r.text)], r


def test_line_dedup_of_a_very_long_text(spark):
    long = "\n".join(f"line number {k} of a text that is very long indeed" for k in range(30_000))
    rows = [(1, long), (2, "short\n" + long), (3, "line number 7 of a text that is very long indeed")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].text_kept, got[2].n_removed, got[3].text_kept) == (0, "short", 30_000, "")


def test_line_dedup_clashing_columns_and_empty(spark):
    rows = [(1, "a b c d e f g h i j", 7, "q"), (2, "a b c d e f g h i j", 8, "r")]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, n_lines int, key string"))
    assert {(r.doc_id, r.key, r.n_removed, r.text_kept) for r in out.collect()} == {(1, "q", 0, "a b c d e f g h i j"), (2, "r", 1, "")}
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_rule_statistics(spark):
    rng = random.Random(3)
    texts = [None, "", "   \n", "one", "é" * 500, "# * a|b <x>\n# * a|b <x>\n\n", "a b c d e f g h " * 40]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(5, 60))) for _ in range(30)]
    texts += ["\n".join(rng.choice(["u v w x y z", "p q\x0br", "ü & ü"]) for _ in range(9)) for _ in range(10)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in quality_rules.statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(texts[r.doc_id]), texts[r.doc_id]


def test_exact_tail(spark):
    from math import comb

    rows = [(n, k) for n in (0, 1, 5, 40, 300) for k in (0, 1, 3, 20) if k <= n]
    got = spark.createDataFrame(rows, "n long, k long").select("n", "k", quality_rules.tail(F.col("n"), F.col("k"), 0.05).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(sum(comb(r.n, j) * 0.05**j * 0.95 ** (r.n - j) for j in range(r.k + 1)), rel=1e-9)


def test_rules_bound_false_rejections(spark):
    good = [(k, f"plain words number {k} " * 3 + " ".join(f"w{k}x{j}" for j in range(30)), "en", "s", 1) for k in range(3000)]
    bad = [(10_000 + k, " ".join(f"#{k}{j} | *" for j in range(30)), "en", "s", 1) for k in range(100)]
    odd = [(20_000, None, None, None, None), (20_001, "", "en", None, None)]
    docs = spark.createDataFrame(good + bad + odd, DOCS)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert len(got) == 3102
    assert sum(not got[r[0]].kept for r in good) <= 90
    assert not any(got[r[0]].kept for r in bad)
    assert got[20_000].base_failed and not got[20_001].kept
    none = quality_rules.quality_rules(docs, labels.limit(0)).where("doc_id < 20000")
    assert none.where("kept = base_failed").count() == 0
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0


def brute_kept(rows, labels, params):
    """kept of every row, by the definitions: binomial tails summed as fractions of whole numbers, the path step by step."""
    from math import comb

    stats = {}
    for i, t, lang in rows:
        n, chars, symbols, dup, repeat = brute_stats(t)
        lines = sum(1 for x in (t or "").split("\n") if WORD.search(x))
        share = lambda a, b: a * 1000 // max(b, 1)
        pm = {"symbol_pm": share(symbols, chars), "dup_line_pm": share(dup, lines), "repeat_pm": share(repeat, n), "short_word_pm": share(n, chars)}
        pm |= {"upper_pm": share(len(re.findall("[A-Z]", t or "")), chars), "digit_pm": share(len(re.findall("[0-9]", t or "")), chars)}
        stats[i] = (lang or "", n < 20 or 100 * repeat > 30 * n, pm)
    good = {d for d, q in labels if q == 1} - {d for d, q in labels if q != 1}
    strata = {}
    for i in good & set(stats):
        if not stats[i][1]:
            strata.setdefault(stats[i][0], []).append(stats[i][2])
    steps = [(r.name, sorted(r.grid, reverse=True)[k]) for k in range(8) for r in params.rules]
    taken = {}
    for lang, own in strata.items():
        taken[lang] = []
        for t in range(1, len(steps) + 1):
            k, n = sum(any(pm[r] > c for r, c in steps[:t]) for pm in own), len(own)
            if sum(comb(n, j) * params.alpha**j * (1 - params.alpha) ** (n - j) for j in range(k + 1)) > params.delta / len(strata):
                break
            taken[lang] = steps[:t]
    return {i: not failed and not any(pm[r] > c for r, c in taken.get(lang, [])) for i, (lang, failed, pm) in stats.items()}


def test_kept_matches_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for k in range(900):
        lang = ("en", "de", None)[k % 9 % 3 if k % 9 < 4 else 0]
        words = [rng.choice(["plain", "words", f"w{rng.randrange(900)}", "Upper", "x"]) + str(rng.randrange(99)) * (rng.random() < 0.05) for _ in range(rng.randrange(15, 60))]
        if rng.random() < 0.1:
            words += ["#|*"] * rng.randrange(1, 12)
        rows.append((k, " ".join(words) + "\nsame line here" * rng.choice([0, 0, 0, 2, 3]), lang))
    labels = [(k, int(rng.random() < 0.9)) for k in range(0, 900, 1)] + [(5, 0), (10_000, 1), (None, 1)]
    params = quality_rules.Params(alpha=0.08, delta=0.2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int"), params).collect()}
    want = brute_kept(rows, labels, params)
    assert got == want
    # Some rule rejects more than the base rules in the large stratum, and a stratum of few rows has no cutoff.
    base = {i for i, t, _ in rows if brute_stats(t)[0] < 20 or 100 * brute_stats(t)[4] > 30 * brute_stats(t)[0]}
    assert any(not k for i, k in got.items() if i not in base)


def test_rules_leave_other_columns_alone(spark):
    docs = spark.createDataFrame([(1, "some words here", "mine", 4, 5, "q")], "doc_id long, text string, `_w` string, `w` int, n_lines int, `a.b` string")
    row = quality_rules.statistics(docs).collect()[0].asDict()
    assert (row["_w"], row["w"], row["n_lines"], row["a.b"], row["n_words"]) == ("mine", 4, 5, "q", 3)
    long = "word " * 300_000 + "\n" + "one two three four five six seven eight " * 2
    row = quality_rules.statistics(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()[0]
    assert (row.n_words, row.n_dup_lines) == (300_016, 0)


def test_chat_collapse(spark):
    def conv(c, *turns):
        return [(c, n, role, text) for n, (role, text) in enumerate(turns)]

    a, b, c = ("user", "hi"), ("assistant", "ho"), ("user", None)
    rows = conv(1, a) + conv(2, a, b) + conv(3, a, b) + conv(4, a, c) + conv(5, b) + conv(None, a, b, a) + conv(7, a, b, c)
    got = {r.conv_id: r for r in chat.render(chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(got) == {4, 5, None, 7}
    assert got[4].rendered == "<|user|>\nhi\n<|user|>\n\n"
    assert chat.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_ties_long_texts_and_other_columns(spark):
    """Turns with one number follow by role and text; columns that are called like inner ones are ignored."""
    long = "word " * 200_000
    schema = "conv_id long, turn long, role string, text string, n int, total int, a string, id long"
    more = (1, 2, "x", 3)
    rows = [(1, 0, "user", "b", *more), (1, 0, "user", "a", *more), (1, None, "z", long, *more)]
    rows += [(2, 0, "user", "a", *more), (2, None, "z", long, *more)]
    rows += [(3, 1, "user", "a", *more), (3, 1, "user", "a", *more)] + [(4, k, "user", f"t{k}", *more) for k in range(3000)] + [(5, k, "user", f"t{k}", *more) for k in range(2999)]
    got = {r.conv_id: r for r in chat.collapse(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 3, 4} and got[4].n_turns == 3000
    assert [t.text for t in got[1].turns] == [long, "a", "b"] and [t.text for t in got[3].turns] == ["a", "a"]
