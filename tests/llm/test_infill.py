import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import infill

BEGINS = {"codepoints": r"(?s).", "words": r"(?s)(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*)|[\x20\x09-\x0D]+", "lines": r"(?s)[^\n]*\n|[^\n]+"}
TEXTS = ["", "a", "é", "one two  three\n\nfour ü", "  lead and trail \n", "x" * 50, "\n\n\n", "日本語 テキスト\nと😀 emoji", "<P>inside", "a<S", "<", "<M>", "ab\x00cd \u0085 e"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def units_of(text, units):
    found = [m.group() for m in re.finditer(BEGINS[units], text)]
    if units == "words" and found and text[0] in " \t\n\x0b\x0c\r":  # leading blanks are a unit of their own
        lead = re.match(r"[\x20\x09-\x0D]+", text).group()
        found = [lead, *([found[0][len(lead):]] if len(found[0]) > len(lead) else []), *found[1:]]
    assert "".join(found) == text
    return found


def plain(doc_id, text, units="codepoints"):
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    us = units_of(text, units)
    a, b = sorted((h[0] % (len(us) + 1), h[1] % (len(us) + 1)))
    p, m, s = ("".join(x) for x in (us[:a], us[a:b], us[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(us), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(us), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(us), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units", sorted(BEGINS))
@pytest.mark.parametrize("chunk,block", [(1, 1), (3, 7), (4096, 1 << 20)])
def test_chunks_find_every_unit(units, chunk, block):
    column = pa.array(TEXTS).slice(1)
    data, starts = infill._parts(column)
    found = infill.Chunks(data, starts, units, chunk, block)
    for k, text in enumerate(TEXTS[1:]):
        us = units_of(text, units)
        assert found.units[k] == len(us)
        ranks = np.arange(len(us) + 1)
        got = found.offsets(np.full(len(ranks), k), ranks)
        assert got.tolist() == [len("".join(us[:r]).encode()) for r in ranks]


@pytest.mark.parametrize("units", sorted(BEGINS))
def test_against_a_plain_version(spark, units):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(3, TEXTS[3]), (3, "other"), (None, "no id"), (None, None), (70, "long " * 5000 + "é")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, h1 string, n int, form int")
    made = infill.fill_in_middle(docs, units=units)
    got = sorted(map(repr, map(tuple, made.collect())))
    assert got == sorted(repr((i, *plain(i, t or "", units))) for i, t in rows)
    again = sorted(map(repr, ((r["doc_id"], r["restored_sha256"]) for r in infill.digests(made).collect())))
    assert again == sorted(repr((i, sha(t or ""))) for i, t in rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert infill.digests(infill.fill_in_middle(empty)).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(empty.withColumnRenamed("doc_id", "Form"), id_col="Form")
    odd = spark.createDataFrame([("k", "some text")], "text2 string, Text string")
    assert infill.fill_in_middle(odd, id_col="text2", text_col="Text").count() == 1
