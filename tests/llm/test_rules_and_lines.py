import random
import re
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from framewright.llm import lines, rules

WS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_base_counts(spark):
    random.seed(4)
    texts = ["".join(random.choice("ab \n\t#|<é\x0b中") for _ in range(random.randint(0, 120))) for _ in range(300)] + [None, "", " \n ", "a", "a b", "a b c a b c a b", "x\r\nx\r\nx", "w " * 30000]
    docs = spark.createDataFrame([(i, t, [None, "en", "xx"][i % 3], 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: r for r in rules.score_documents(docs).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert rules.score_documents(docs.where("false")).count() == 0


def prose(rng, n):
    common = ["the", "of", "and", "to", "in", "that", "is", "was"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) + rng.choice(["", "", ".", ","]) for _ in range(n))


def test_odd_documents_are_rejected_and_prose_is_kept(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 200), "en") for i in range(60)]
    rows += [(100, prose(rng, 200).upper().replace(" ", "!! "), "en"), (101, prose(rng, 200).replace(" ", "### "), "en"), (102, " | ".join("".join(rng.choice("etaoinsh") for _ in range(6)) for _ in range(200)), "en")]
    got = {r.doc_id: r for r in rules.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in (100, 101, 102))
    kept = rules.keep_good(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, classes string"))
    assert kept.columns == ["doc_id", "text", "lang", "classes"] and kept.count() == 60


def test_distance_is_0_for_equal_and_1_for_apart(spark):
    df = spark.createDataFrame([([1, 3, 0],), ([0, 0, 5],), ([0, 0, 0],)], "c array<long>")
    d = [r[0] for r in df.select(rules.js_distance(F.col("c"), F.array(F.lit(0.25), F.lit(0.75), F.lit(0.0)))).collect()]
    assert d == [pytest.approx(0, abs=1e-9), pytest.approx(1), 0.0]


def deduped(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, drop string")
    out = lines.dedup_lines(df, **options)
    assert out.columns == ["doc_id", "text", "drop", "n_lines", "n_removed"]
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)


def test_runs_of_lines_go_once_repeated(spark):
    run = "one a\ntwo b\nthree c\nfour d"
    got = dict((i, (t, n)) for i, t, _, n in deduped(spark, [(1, f"x 1\n{run}\ny 1"), (2, f"{run}\n\nz 2"), (3, f"q\ntwo b\nthree c\nr"), (4, None), (5, ""), (6, "one a")]))
    assert got[1] == (f"x 1\n{run}\ny 1", 0)
    assert got[2] == ("\nz 2", 4)
    assert got[3] == ("q\ntwo b\nthree c\nr", 0)  # two short lines are no run
    assert got[4] == (None, 0) and got[5] == ("", 0) and got[6] == ("one a", 0)


def test_one_long_line_is_a_run(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    got = {i: (t, n) for i, t, _, n in deduped(spark, [(1, f"a\n{passage}"), (2, f"{passage}\nb"), (3, passage)])}
    assert got == {1: (f"a\n{passage}", 0), 2: ("b", 1), 3: ("", 1)}


def test_repeats_inside_one_document_and_equal_rows(spark):
    block = "l1 a\nl2 b\nl3 c"
    got = deduped(spark, [(1, f"{block}\nmid\n{block}"), (1, f"{block}\nmid\n{block}"), (None, "n")])
    assert got == sorted([(1, f"{block}\nmid", 7, 3)] * 2 + [(None, "n", 1, 0)], key=str)


def test_every_line_keeps_one_copy(spark):
    rng = random.Random(6)
    pool = [f"line {k} {'w ' * rng.randint(1, 30)}" for k in range(40)]
    rows = []
    for i in range(120):
        at = rng.randrange(30)
        rows.append((i, "\n".join([*rng.sample(pool, 3), *pool[at : at + rng.randint(2, 8)], f"own {i}"])))
    got = deduped(spark, rows)
    left = {x for _, t, _, _ in got for x in t.split("\n")}
    assert {x for _, t in rows for x in t.split("\n")} <= left
    assert sum(n for *_, n in got) > 100
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def n_words(lines):
    return sum(len(WS.findall(x)) for x in lines)


def brute(rows):
    """Texts and counts by the definition: every run, of any length, is looked for among all that start earlier."""
    docs = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0], xxhash.xxh64_intdigest(r[1], seed=42) ^ 1 << 63))
    content = {d: [k for k, x in enumerate(d[1].split("\n")) if WS.search(x)] for d in docs}
    seen, want = set(), {}
    for d in docs:
        lines = d[1].split("\n")
        ls, gone = [lines[k] for k in content[d]], set()
        for p in range(len(ls)):
            for k in range(1, len(ls) - p + 1):
                run = tuple(ls[p : p + k])
                if k >= 3 or n_words(run) >= 50:
                    gone |= set(range(p, p + k)) if run in seen else set()
            seen |= {tuple(ls[p : p + k]) for k in range(1, len(ls) - p + 1)}
        cut = {content[d][p] for p in gone}
        want[d] = ("\n".join(x for k, x in enumerate(lines) if k not in cut), len(ls), len(gone))
    return sorted(((i, *want[i, t]) for i, t in rows), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(12)
    for size in (2, 4, 8):
        pool = [f"l{k}" if rng.random() < 0.6 else f"l{k} " + "w " * rng.choice([20, 24, 30, 60]) for k in range(size * 4)] + ["", "  ", "\t\r"]
        rows = [(rng.randrange(60), "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for _ in range(80)]
        assert deduped(spark, rows) == brute(rows)


def test_runs_whose_parts_come_first_elsewhere(spark):
    rows = []
    for k in range(20):
        a, b, c = (f"{x}{k} line" for x in "abc")
        near = [[a, b, "x"], [b, c], [a, b, c], [a, b, c]]  # each pair is first in a document that goes on in another way
        rows += [(4 * k + j, "\n".join([f"p{k} {j}", *ls, f"q{k} {j}"])) for j, ls in enumerate(near)]
    got = deduped(spark, rows)
    assert got == brute(rows)
    assert all(n == 3 * (i % 4 == 3) for i, _, _, n in got)


def test_very_long_texts_and_clashing_names(spark):
    many = "\n".join(f"line {k}" for k in range(100_000))
    same = "\n".join(["same line"] * 100_000)
    rows = [(1, many, "a", "b", "c"), (2, many, "a", "b", "c"), (3, same, "a", "b", "c")]
    began = time.monotonic()
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, `__key` string, `__DROP` string, `N_Lines` string"))
    got = {r.doc_id: r for r in out.collect()}
    assert time.monotonic() - began < 60
    assert out.columns == ["doc_id", "text", "__key", "__DROP", "n_lines", "n_removed"] and got[2]["__key"] == "a"
    assert (got[1].n_removed, got[2].n_removed, got[2].text) == (0, 100_000, "")
    assert got[3].n_removed == 99_999 and got[3].n_lines == 100_000
