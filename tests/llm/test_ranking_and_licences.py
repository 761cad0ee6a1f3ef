import random
import zlib

import numpy as np
import pytest

from framewright.llm import licences, ranking


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = {r.doc_id: r for r in ranking.score_documents(docs, ranking.fit(docs, labels)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in scored.items())
    test = [(x.quality, scored[x.doc_id]) for x in labels.collect() if scored[x.doc_id].held_out]
    good, bad = ([r.score for y, r in test if y == k] for k in (1, 0))
    assert np.mean([y == r.predicted for y, r in test]) > 0.9
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_pair_loss_orders_and_quantile_cuts():
    rng = np.random.default_rng(16)
    y = rng.integers(0, 2, 400)
    x = np.stack([y * 1.5 + rng.normal(size=400), rng.normal(size=400)], axis=1)
    w = ranking.fit_pairs(x, y, pairs=20000)
    assert w[0] > 0.8 and abs(w[1]) < 0.4
    u = np.array([0.0, 1.0, 2.0, 3.0])
    assert ranking.best_quantile(u, np.array([0, 0, 1, 1])) == 0.5 and 1 < ranking.at_quantile(u, 0.5) < 2
    assert ranking.at_quantile(u, 0) < 0 and ranking.at_quantile(u, 1) > 3 and ranking.at_quantile(u[:0], 0.5) == 0.0
    assert (ranking.fit_pairs(x, np.ones(400)) == 0).all() and ranking.best_quantile(np.zeros(0), np.zeros(0)) == 0.0


def test_edges_of_scores(spark):
    docs = spark.createDataFrame([(1, "the of and", "en", 5.0), (2, None, None, 5.0), (None, "", "xx", 5.0), (1, "the of and", "en", 5.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    rows = ranking.score_documents(docs, ranking.fit(docs, labels)).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[3].score
    assert ranking.score_documents(docs.where("false"), ranking.fit(docs.where("false"), labels)).count() == 0


def longest(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def test_banded_alignment_equals_the_full_one_inside_its_band():
    rng = random.Random(17)
    for _ in range(200):
        a = np.array([rng.randrange(6) + 1 for _ in range(rng.randint(1, 14))])
        b = np.array([rng.randrange(6) + 1 for _ in range(rng.randint(1, 14))])
        n, first, last = licences.align(a, b, 0, band=14)
        assert n == longest(a, b) and (n == 0 or 0 <= first <= last < len(b))


def test_winnowing_guarantees_a_fingerprint():
    rng = np.random.default_rng(18)
    h = rng.integers(0, 50, 300).astype(np.uint64)
    picked = licences.winnow(h, 4)
    assert all(any(s <= p < s + 4 for p in picked) for s in range(297))


def test_scan(spark):
    mit, apache = licences.TEMPLATES["mit"], licences.TEMPLATES["apache-2.0-notice"]
    text = f"Été prose before. {mit.replace('copy', 'copie', 1).replace('Software', 'Program', 1)} and after. {apache}"
    docs = spark.createDataFrame([(1, text, "x"), (2, "plain words without any notice", "x"), (3, None, "x"), (None, apache.upper(), "x"), (4, "Licensed under the sun", "x"), (5, "word " * 50000 + apache, "x"), (5, "word " * 50000 + apache, "x")], "doc_id long, text string, license string")
    found = licences.scan_licences(docs)
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [r.license for r in sorted(by[1], key=lambda r: r.start)] == ["mit", "apache-2.0-notice"]
    first = min(by[1], key=lambda r: r.start)
    assert text[first.start : first.stop].startswith("Permission") and text[first.start : first.stop].endswith("SOFTWARE") and 0.9 < first.coverage < 1
    assert by[None][0].coverage == 1.0 and len(by[5]) == 2 and by[5][0].start == 250000 and not {2, 3, 4} & set(by)
    whole = licences.licence_report(docs).collect()
    assert len(whole) == 7 and {r.doc_id: (r.n_licenses, r.best_coverage, r.spans) for r in whole}[2] == (0, 0.0, "")
    assert {r.doc_id: r.n_licenses for r in whole} == {1: 2, 2: 0, 3: 0, None: 1, 4: 0, 5: 1}
    assert licences.scan_licences(docs.where("false")).count() == 0
    assert first.coverage == pytest.approx(first.matched / len(licences._word.findall(mit)))


def test_rows_that_share_an_id_are_reported_each(spark):
    mit, nothing = licences.TEMPLATES["mit-notice"], "nothing"
    docs = spark.createDataFrame([(1, mit, "x"), (1, nothing, "x"), (1, f"{mit} {mit}", "x")], "doc_id long, text string, spans string")
    assert sorted((r.n_licenses, r.spans) for r in licences.licence_report(docs).collect()) == [(0, ""), (1, "mit-notice:0:30"), (2, "mit-notice:0:30,mit-notice:32:62")]
    assert licences.licence_report(docs.where("false")).count() == 0


def test_whole_licences_are_told_from_their_openings():
    index = licences.Index(licences.TEMPLATES)
    for name, text in licences.TEMPLATES.items():
        assert [(m[0], m[2]) for m in licences.matches(f"Before it. {text} After it.", index)] == [(name, 1.0)]
    assert not licences.matches(licences.TEMPLATES["mit"].split("THE SOFTWARE IS")[0], index)


NO_LICENCE = [
    "Licensed under the Apache License.",
    "Licensed under the BSD License.",
    "Licensed under CC BY-SA 4.0.",
    "Licensed under CC BY-NC 2.0.",
    "Licensed under CC BY-NC-ND 4.0.",
    "Licensed under CC BY-NC-4.1.",
    "This work is licensed under a Creative Commons Attribution 3.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-Non-Commercial-ShareAlike 4.0 International License.",
    "This work is licensed under the GNU General Public License, version 2.",
    "This work is licensed under the GNU General Public License, version 3.1.",
    "This work is licensed under the GNU Lesser General Public License, version 3.",
    "Licensed under the Eclipse License, Version 2.0.",
    "Released under the MIT-0 License.",
    "Released to the press under the new MIT License.",
]


@pytest.mark.parametrize("text", NO_LICENCE)
def test_sentences_of_other_licences_are_not_named(text):
    assert licences.matches(f"Before it. {text} After it.", licences.Index(licences.TEMPLATES)) == []


@pytest.mark.parametrize("text,name", [("Licensed under CC BY-NC 4.", "cc-by-nc-4.0-notice"), ("Licensed under the Apache License, Version 2.", "apache-2.0-notice"), ("this work is licensed under GNU General Public License version 3.0", "gpl-3.0-notice")])
def test_other_ways_to_write_the_same(text, name):
    assert [m[0] for m in licences.matches(f"Before it. {text} After it.", licences.Index(licences.TEMPLATES))] == [name]


def test_one_telling_word_changed_is_another_licence():
    """No template is named for a text of it in which a telling word is another, is gone, or has one more before it."""
    index = licences.Index(licences.TEMPLATES)
    tried = 0
    for name, text in licences.TEMPLATES.items():
        places = [m.span() for m in licences._word.finditer(text)]
        for k, (a, b) in enumerate(places):
            word = text[a:b].lower()
            if word not in licences.TELLING and not (word.isdigit() and licences.telling(text, places, k, k)[:1] == [word] and word != "0"):
                continue
            other = "7" if word.isdigit() else "eclipse"
            for changed in (text[:a] + other + text[b:], text[:a] + text[b:], text[:a] + ("Lesser " if k else "Eclipse-") + text[a:]):
                found = [m[0] for m in licences.matches(f"Before it. {changed} After it.", index)]
                assert name not in found, changed
                tried += 1
    assert tried > 100


def test_whole_texts_can_be_given():
    rng = random.Random(5)
    long = {"long-1.0": " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(90)) for _ in range(1500))}
    index = licences.Index(licences.TEMPLATES | long)
    words = long["long-1.0"].split()
    del words[700:705]
    words[300:300] = ["some", "other", "words"]
    (found,) = licences.matches(f"Before. {' '.join(words)} After.", index)
    assert found[0] == "long-1.0" and found[1] == 1495


def brute_scan(text, index, min_coverage):
    """Every template aligned without a band at every word where one of its words is; overlaps go by rank."""
    words = [w.lower() for w in licences._word.findall(text)]
    places = [m.span() for m in licences._word.finditer(text)]
    ids = np.array([index.vocab.get(w, 0) for w in words])
    found = {}
    for t, template in enumerate(index.words):
        n, band = len(template), index.bands[t]
        for at in range(-n, len(ids)):
            lo = max(0, at - band)
            part = ids[lo : max(0, at + n + band)]
            m, first, last = licences.align(template, part, at - lo, band)
            if m / (n + last - first + 1 - m) >= min_coverage and licences.telling(text, places, lo + first, lo + last) == index.telling[t]:
                found[t, lo + first, lo + last] = max(m, found.get((t, lo + first, lo + last), 0))
    kept = []
    for (t, a, b), m in sorted(found.items(), key=lambda f: (-f[1], -f[1] / len(index.words[f[0][0]]), f[0][1], f[0][0])):
        if all(b < a2 or b2 < a for _, a2, b2 in kept):
            kept.append((t, a, b))
    return sorted((a, index.names[t]) for t, a, b in kept)


def test_scan_finds_what_brute_force_finds():
    rng = random.Random(21)
    names = ["mit-notice", "apache-2.0-notice", "cc-by-4.0-notice", "gpl-3.0-notice", "mpl-2.0-header", "cc-by-nc-4.0-notice"]
    index = licences.Index({k: licences.TEMPLATES[k] for k in names})
    compared = 0
    for _ in range(60):
        words = [f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 8))]
        for name in rng.sample(names, rng.randint(0, 3)):
            part = licences._word.findall(licences.TEMPLATES[name])
            for _ in range(rng.randint(0, max(1, len(part) // 14))):
                k = rng.randrange(len(part))
                part[k : k + 1] = rng.choice([[], ["other"], [part[k], "more"]])
            words += [*part, *(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 8)))]
        text = " ".join(words)
        starts = {m.start(): k for k, m in enumerate(licences._word.finditer(text))}
        got = [(starts[a], name) for name, _, _, a, _ in licences.matches(text, index)]
        assert got == brute_scan(text, index, licences.MIN_COVERAGE), text
        compared += len(got)
    assert compared > 15


def test_overlaps_are_settled_in_order_of_rank():
    rng = random.Random(22)
    for _ in range(100):
        spans = [(rng.randint(1, 9), 1.0, a, a + rng.randint(0, 6), 0) for a in (rng.randrange(40) for _ in range(20))]
        kept = []
        for f in sorted(spans, key=lambda f: (-f[0], -f[1], f[2], f[4])):
            if all(f[3] < g[2] or g[3] < f[2] for g in kept):
                kept.append(f)
        assert licences.apart(spans) == sorted(kept, key=lambda f: f[2])
