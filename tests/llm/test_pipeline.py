import random
import re
from collections import Counter
from itertools import combinations
from math import log1p

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from framewright.llm import pii
from test_pii import plain


def test_stages_one_after_the_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = corpus_pipeline.stage_out(stage(spark, docs, sf_dir), name)
        assert new.columns == docs.columns and new.dtypes == docs.dtypes
        sizes.append(new.count())
        assert new.select("doc_id").distinct().count() == sizes[-1]
        assert new.where("n_chars <> char_length(text)").count() == 0
        docs = new
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 50
    assert not any(pii.base_spans(r.text) for r in docs.select("text").collect())
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(model.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == want
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()} == set(want)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_removed string, `__KEY` string, kept boolean, __lines string"
COMMON = ["the", "of", "and", "to", "in", "that", "is", "was"]


def line(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(n))


def fixture():
    rng = random.Random(30)
    prose = lambda: [line(rng, 14) for _ in range(10)]
    passage = [line(rng, 20), line(rng, 20), line(rng, 20)]
    texts = [prose() for _ in range(30)]
    texts += [[*prose()[:5], *passage, *prose()[:3]] for _ in range(4)]  # a passage that several share
    texts += [list(texts[3]), list(texts[3])]  # exact copies, of which no line is left
    for k in range(3):  # copies with other words at the end of each line
        texts.append([" ".join([*x.split()[:-1], f"other{'abc'[k]}"]) if i in (2 + k,) else x + "," for i, x in enumerate(texts[7])])
    texts += [[*prose(), "mail a.b@example.org or +1 555 010 2030"], ["few words here"], [""], ["? ! ?"]]
    rows = [(i, "\n".join(x)) for i, x in enumerate(texts)]
    rows += [(100, None), rows[5], (None, "\n".join(prose())), (6, "\n".join(prose()))]
    return [(i, t, "en", "s", len(t or ""), "r", "k", True, "l") for i, t in rows]


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_lines(rows):
    """Later repeats of three lines, or fewer with 50 words, go; rows are (id, text), without two texts of one id that share lines."""
    out, seen = [], {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ls = text.split("\n")
        gone = set()
        for p in range(len(ls)):
            for k in range(1, len(ls) - p + 1):
                run = tuple(ls[p : p + k])
                if (k >= 3 or n_words(" ".join(run)) >= 50) and seen.setdefault(run, (i, text, p)) != (i, text, p):
                    gone |= set(range(p, p + k))
        if len(gone) < len(ls):
            out.append((i, "\n".join(x for p, x in enumerate(ls) if p not in gone)))
    return out


def brute_near(rows):
    """The first of each component of texts whose weighted Jaccard similarity is 0.8 or more; rows without an id stay."""
    keyed = [(i, t) for i, t in rows if i is not None]
    bags = []
    for _, t in keyed:
        w = re.findall(r"\w+", t.lower())
        bags.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
    df, n = Counter(s for b in bags for s in b), len(bags)
    weighted = [{s: c * log1p(n / (df[s] + n / 4)) for s, c in b.items()} for b in bags]
    label = list(range(n))
    for _ in range(n):
        for a, b in combinations(range(n), 2):
            x, y = weighted[a], weighted[b]
            shared = sum(min(x[s], y[s]) for s in x.keys() & y.keys())
            if shared >= 0.8 * (sum(x.values()) + sum(y.values()) - shared):
                label[a] = label[b] = min(label[a], label[b])
    return [r for k, r in enumerate(keyed) if label[k] == k] + [r for r in rows if r[0] is None]


def brute_pii(text):
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in plain(text)):
        out += [text[at:a], f"<{pii.KINDS[kind].upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def test_every_stage_equals_brute_force(spark, sf_dir):
    docs = spark.createDataFrame(fixture(), SCHEMA)
    rows = [(r[0], r[1]) for r in fixture()]
    # the fixture's prose is alike, so that only the base rules reject any of it
    quality = [r for r in rows if n_words(r[1]) >= 50]
    unique = sorted(set(brute_lines(quality)), key=str)
    near = sorted(brute_near(sorted(unique, key=lambda r: (r[0] is not None, r[0] or 0))), key=str)
    assert len(rows) > len(quality) > len(unique) > len(near) > 30
    wants = [sorted(quality, key=str), unique, near, sorted(((i, brute_pii(t)) for i, t in near), key=str)]
    for (name, stage), want in zip(corpus_pipeline.STAGES, wants):
        new = corpus_pipeline.stage_out(stage(spark, docs, sf_dir), name)
        assert new.columns == docs.columns and new.dtypes == docs.dtypes
        got = new.collect()
        assert sorted({(r.doc_id, r.text) for r in got}, key=str) == sorted(set(want), key=str), name
        assert all((r.n_removed, r["__KEY"], r.kept, r["__lines"]) == ("r", "k", True, "l") for r in got)
        assert name == "quality_rules" or all(r.n_chars == len(r.text) for r in got)
        docs = new
    assert new.where("text like '%<EMAIL>%<PHONE>%'").count() == 1
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    sizes = Counter()
    for r in packed:
        sizes[r.doc_id] += r.length
    want = Counter()
    for i, t in wants[-1]:
        want[i] += len(model.encode(t, add_special_tokens=False).ids) + 1
    assert sizes == want


def test_stages_of_an_empty_table_are_empty(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None, None, None, None, None)] * 2 + [(None, "", "en", "s", 0, "r", "k", True, "l")], SCHEMA)
    counts = [stage(spark, odd, sf_dir).count() for _, stage in corpus_pipeline.STAGES]
    assert counts == [0, 3, 2, 3, 3]
