import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from framewright.llm import pii

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The patterns as they stand."""
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        twice = [d * 2 - 9 * (d > 4) if k % 2 else d for k, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(twice) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(11)
    for alphabet in ("ab1.@-+ ()%_456é", "0123456789 -.", "a@.b_", "+1( )2"):
        for _ in range(8000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("4111 1111-1111 1111 and a.b@x-y.example.org, 10.0.0.1") == [(0, 24, 43), (1, 45, 53), (2, 0, 19)]


def test_long_texts_take_linear_time():
    for t in ("a" * 1_000_000, "1" * 300_000, "@" * 300_000, "a@" * 200_000, "1." * 200_000, "+1" + "(" * 300_000, "1 " * 300_000):
        pii.base_spans(t)


def test_contexts_add_unseen_identifiers(spark):
    seeds = [f"reach phone: +1 555 010 {1000 + i} thanks" for i in range(30)]
    rows = [(i, t) for i, t in enumerate(seeds)] + [(100, "reach phone: 555-010-7777 thanks"), (101, "sum 5550107778 of things"), (102, "again 555-010-7777 here"), (103, "clean words only")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[100].added] == [(3, 13, 25)] and [tuple(s) for s in got[102].added] == [(3, 6, 18)]
    assert not got[101].added and not got[103].added and not got[103].base
    d = {r.doc_id: r for r in pii.digests(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert d[100].n_phone == 0 and d[100].spans == "phone:13:25" and d[0].n_phone == 1


def added(spark, texts):
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {texts[r.doc_id][s.start : s.stop] for r in got for s in r.added}


def test_plain_numbers_beside_punctuation_are_left_alone(spark):
    texts = [f"w{i} x{i} +1 555 010 {1000 + i}, y{i} z{i}" for i in range(30)] + [f"the town{i} has 1234511{i}, people{i} and 555-010-77{i:02d}. More" for i in range(30)]
    assert added(spark, texts) == set()
    often = [f"call +1 555 010 {1000 + i} now" for i in range(10)] + ["we call 5550107779 a number"] + ["to call, Call; (call) a thing"] * 40
    assert added(spark, often) == set()  # the word stands mostly elsewhere, whatever signs touch it


def test_rounds_go_on_to_the_end(spark):
    number = lambda k, i: f"555-0{k}0-{1000 + i}"
    texts = [f"word0 +1 555 010 {1000 + i}" for i in range(8)]
    for k in range(1, 8):
        texts += [f"word{k - 1} {number(k, i)}" for i in range(6)] + [f"word{k} {number(k, i)}" for i in range(6)] * 2
    assert added(spark, texts) == {number(k, i) for k in range(1, 8) for i in range(6)}


def test_words_and_candidates_of_any_length_are_whole(spark):
    long, mail = "l" * 500, "a" * 400 + "@host"
    texts = [f"{long} {' ' * 300}x{i}@y.example.org" for i in range(8)] + [f"{long}: {mail} end"]
    assert added(spark, texts) == {mail}
    assert pii._near("ab cd" + " " * 999 + "X" + "." * 999 + "ÉF", 1004, 1005) == ("cd", "éf") and pii._near("..1..", 2, 3) == (None, None)
    began = time.monotonic()
    pii.occurrences("w" * 500_000 + " 1@2.3 " + "." * 500_000 + " 4@5.6 7@8.9", pii.base_spans("w" * 500_000 + " 1@2.3 " + "." * 500_000 + " 4@5.6 7@8.9"))
    assert time.monotonic() - began < 20


def test_columns_of_any_name_survive(spark):
    rows = [(1, "a@b.cd", "k", "i", "t", "a")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, __ID string, `__th` string, __added string")
    got = pii.redact(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "<EMAIL>", "k", "i", "t", "a")] * 2


def test_redaction_and_edges(spark):
    rows = [(1, "mail a.b@c.de now +1 (555) 010-2030.", "x"), (2, None, "x"), (3, "", "x"), (None, "10.0.0.1", "x"), (1, "mail a.b@c.de now +1 (555) 010-2030.", "x"), (4, "clean é 12", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted([("1", "mail <EMAIL> now <PHONE>.")] * 2 + [("2", "None"), ("3", ""), ("None", "<IP>"), ("4", "clean é 12")])
    assert pii.find_personal_data(docs).count() == 6
    assert pii.find_personal_data(docs.where("false")).count() == pii.redact(docs.where("false")).count() == 0
    assert pii.redact(docs, broadcast_rows=-1).where(F.col("text").contains("@")).count() == 0


def test_overlapping_spans_become_one():
    assert pii.redact_text("0123456789", [(0, 1, 4), (3, 3, 6), (2, 8, 9)]) == "0<EMAIL>67<CARD>9"


def by_definition(text):
    """(kind, instance, known, left, right) of each span; neighbours are whole words of the text that lie outside it."""
    words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"\w+", text)]
    spans = [(k, a, b, True) for k, a, b in plain(text)]
    for m in re.finditer(r"\S+", text):
        core = m.group().strip(".,;:!?\"'()[]<>")
        a = m.start() + m.group().find(core)
        kind = next((k for k, fits in pii._loose if fits(core)), None)
        if kind is not None and all(a + len(core) <= c or d <= a for _, c, d, known in spans if known):
            spans.append((kind, a, a + len(core), False))
    for k, a, b, known in spans:
        cut = [any(s < at < e for s, e, _ in words) for at in (a, b)]
        left = None if cut[0] else next((w for s, e, w in reversed(words) if e <= a), None)
        right = None if cut[1] else next((w for s, e, w in words if s >= b), None)
        yield k, text[a:b].lower(), known, left, right


def brute_bootstrap(texts, support=5, precision=0.2, accept=0.5):
    """Accepted (kind, instance), by plain loops over all occurrences until nothing changes."""
    occ = [o for t in texts for o in by_definition(t)]
    totals = Counter(w.lower() for t in texts for w in re.findall(r"\w+", t))
    known = {(o[0], o[1]) for o in occ if o[2]}
    given, found = set(known), set()
    seen = [(k, inst, flag, side, w) for k, inst, flag, left, right in occ for side, w in (("L", left), ("R", right)) if w]
    while True:
        trust = {}
        for k, side, w in {(s[0], s[3], s[4]) for s in seen}:
            hits = [s for s in seen if (s[0], s[3], s[4]) == (k, side, w) and ((s[2] and (s[0], s[1]) in given) or (not s[2] and (s[0], s[1]) in found))]
            if len({(s[1], s[2]) for s in hits}) >= support and len(hits) / totals[w] >= precision:
                trust[k, side, w] = len(hits) / totals[w]
        new = set()
        for k, inst in {(s[0], s[1]) for s in seen if not s[2]}:
            left = 1.0
            for p in {(s[0], s[3], s[4]) for s in seen if not s[2] and (s[0], s[1]) == (k, inst)}:
                left *= 1 - trust.get(p, 0.0)
            if 1 - left >= accept + 1e-9:
                new.add((k, inst))
        if new <= found:
            return found
        found |= new


def test_bootstrapping_equals_brute_force(spark):
    rng = random.Random(31)
    total = 0
    for _ in range(3):
        words = [f"w{k}" for k in range(25)]
        loose = [f"555-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}" for _ in range(12)] + [f"u{k}@host" for k in range(6)]
        fixed = [f"+1 555 0{k:02d} {rng.randrange(1000, 9999)}" for k in range(30)] + [f"m{k}@a.org" for k in range(20)]
        texts = []
        for _ in range(260):
            span = rng.choice(fixed if rng.random() < 0.6 else loose)
            side = rng.choice(["call", "mail"]) if rng.random() < 0.6 else rng.choice(words)
            before, after = rng.choice([""] * 30 + ["x", "call", "_"]), rng.choice([""] * 30 + ["ext", "é", "-", "7"])
            texts.append(f"{rng.choice(words)} {side}{rng.choice([':', ' ', ','])} {before}{span}{after} {rng.choice(words)}. {rng.choice(words)}")
        want = brute_bootstrap(texts)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = pii._scan(docs, "doc_id", "text")
        occ = rows.select("id", "th", F.explode("occ").alias("o")).select("id", "th", "o.*")
        got = {tuple(r) for r in pii.bootstrap(occ, lambda w: pii.count_words(docs, "text", w)).collect()}
        assert got == want
        total += len(want)
    assert total > 10


def test_words_that_a_span_cuts_are_no_context(spark):
    fragments = [f"no +4930123456{k}ext 5" for k in range(6)] + ["serial 12345110 ext port"]
    assert added(spark, fragments) == set()
    cut = [f"at 10.1.{k}.7abc so" for k in range(6)] + ["abc"] * 11 + ["1.2.3.999 abc"]
    assert added(spark, cut) == set()
    assert pii._near("a 1.2.3.4abc d", 2, 9) == ("a", None) and pii._near("tel+1 555 0 x", 3, 11) == ("tel", "x") and pii._near("ab12 c", 2, 4) == (None, "c")
