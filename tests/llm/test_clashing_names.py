"""Every operator on tables with some fifty further columns, of names that it, or another operator, may use inside."""

import sys
from os.path import dirname

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, dirname(dirname(dirname(__file__))))

from framewright.llm import bpe, chat, importance, infill, licences, lines, neardup, packing, pii, ranking, rules, secret_scan, vectors  # noqa: E402

NAMES = """id ID th Th inst known left right __text __lang __id __row __th __key __added __group __rank __measures measures piece start length ids_crc32
sequence_id offset kept n_words words at word bucket gain score rank able place label y z x u h n form output prefix middle suffix a b h1 base added spans row text2
lo hi around component n_links class_id key count value turns role2 matched coverage license stop line pos __lines __removed idx entity kind""".split()
WORDS = "the of and to in is that for it was on with as are this be at by from or have an they which one you were all her she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people mr how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def crowded(df):
    """With further columns whose values would be wrong for any purpose; names that differ by case only are left out."""
    taken, more = {c.lower() for c in df.columns}, []
    for c in NAMES:
        if c.lower() not in taken:
            taken.add(c.lower())
            more.append(F.lit("wrong").alias(c))
    return df.select(*more[: len(more) // 2], "*", *more[len(more) // 2 :])


@pytest.fixture(scope="module")
def docs(spark):
    texts = [" ".join(WORDS[(i * k) % len(WORDS)] for k in range(1, 70)) for i in range(1, 20)]
    texts += [texts[3], None, "", "a.b@c.example.org password=hunter2hunter2 Licensed under the MIT License."]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))


OPERATORS = {
    "op1": lambda d, i: ranking.fit_and_score(d, labels(d.withColumnRenamed(i, "doc_id")).withColumnRenamed("doc_id", i), id_col=i),
    "op2": lambda d, i: packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json"), id_col=i),
    "op3": lambda d, i: pii.digests(pii.find_personal_data(d, id_col=i), id_col=i),
    "op4": lambda d, i: licences.licence_report(d, id_col=i),
    "op5": lambda d, i: rules.score_documents(d, id_col=i),
    "op6": lambda d, i: neardup.near_duplicate_classes(d, id_col=i),
    "op7": lambda d, i: lines.dedup_lines(d, id_col=i),
    "op10": lambda d, i: bpe.encode_documents(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), emit=bpe.emit_digest, emit_schema=bpe.DIGEST_SCHEMA, id_col=i),
    "op11": lambda d, i: secret_scan.digests(secret_scan.find_secrets(d, id_col=i), id_col=i),
    "op12": lambda d, i: importance.importance_resample(d, d, id_col=i),
    "op13": lambda d, i: infill.digests(infill.fill_in_middle(d, id_col=i), id_col=i),
}


def rows(df, columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


@pytest.mark.parametrize("op,name", zip(sorted(OPERATORS), ["ID", "__text", "__row", "id", "row", "kept", "at", "__id", "text2", "Th", "word"]))
def test_further_columns_and_odd_ids_change_nothing(docs, op, name):
    plain, full = OPERATORS[op](docs, "doc_id"), OPERATORS[op](crowded(docs.withColumnRenamed("doc_id", name)), name)
    columns = [c for c in plain.columns if c not in ("doc_id", "text", "sequence_id", "offset")]
    assert plain.count() >= docs.count() and rows(plain, ["doc_id", *columns]) == rows(full, [name, *columns])


def test_names_of_results_are_refused(docs):
    for name in ("piece", "Start", "length"):
        with pytest.raises(ValueError):
            packing.pack_documents(docs.withColumnRenamed("doc_id", name), public_tokenizers.path("word_bpe_49k.json"), id_col=name)


def test_vectors_and_turns(spark):
    data = spark.createDataFrame([(i, [float(i % 3), 1.0, 0.5 * (i % 5)], i) for i in range(30)], "vec_id long, embedding array<double>, label int")
    assert rows(vectors.near_vectors(data), ["vec_id", "n_links", "component_id"]) == rows(vectors.near_vectors(crowded(data)), ["vec_id", "n_links", "component_id"])
    turns = spark.createDataFrame([(1, 0, "user", "a <b"), (1, 1, "assistant", "c"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    one, two = (chat.digests(chat.format_conversations(t)) for t in (turns, crowded(turns)))
    assert rows(one, one.columns) == rows(two, one.columns)
