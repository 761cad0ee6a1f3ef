"""Quality rules on whole texts, in DataFrame expressions only.

Counting rules come first; then a document's character-class and common-word histograms are compared
with its language's reference by Jensen-Shannon distance.  The references are sums over all documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, let, scratch, text_or_empty

# Common function words, most frequent first (fixed values).
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "as", "with", "by", "at", "from", "or", "an"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
LANGUAGES = list(COMMON_WORDS)
# White space between words, as a regular-expression class (fixed values).
BLANK = r"[\x20\x09-\x0D]"
# Character classes whose members are listed; the last class of a histogram is all the rest (fixed values).
LISTED_CLASSES = {
    "upper": r"\p{Lu}",
    "digit": r"0-9",
    "symbol": r"#*$%&|<>",
    "stop": r".,;:",
    "mark": r"!?",
    "blank": r"\x20\x09-\x0D",
}


@dataclass(frozen=True)
class Limits:
    """When a document is rejected.  Distances lie between 0 and 1."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: The class histogram is trusted from so many words on, the word histogram from ``word_guard``, and
    #: two middling distances together from ``joint_guard``.
    guard_words: int = 50
    max_class_distance: float = 0.28
    word_guard: int = 150
    max_word_distance: float = 0.25
    joint_guard: int = 100
    joint_class_distance: float = 0.17
    joint_word_distance: float = 0.24


def _count(text: Column, members: str) -> Column:
    """Code points of ``text`` in a class: what is left when runs of all others are dropped."""
    return F.char_length(F.regexp_replace(text, f"[^{members}]+", "")).cast("long")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the same text."""

    def covered(hashes: Column) -> Column:
        def flagged(order: Column) -> Column:
            twice = F.filter(order, lambda x, j: F.coalesce(F.get(order, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(order, j + 1)["h"] == x["h"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))).cast("long")

        order = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(order, flagged))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


#: All languages' common words.
EVERY_COMMON = sorted({w for c in COMMON_WORDS.values() for w in c})


def _common_of(words: Column) -> Column:
    """The words that are common in any language, a fraction of all."""
    return F.filter(words, lambda w: w.isin(EVERY_COMMON))


def _reference_language(lang: Column, common: Column) -> Column:
    """The document's own language, or else the one whose common words it has most of."""

    def found(listed: list[str]) -> Column:
        return F.size(F.filter(common, lambda w: w.isin(listed)))

    votes = [F.struct(found(c).alias("n"), F.lit(-k).alias("k"), F.lit(x).alias("lang")) for k, (x, c) in enumerate(COMMON_WORDS.items())]
    return F.when(lang.isin(LANGUAGES), lang).otherwise(F.array_max(F.array(*votes))["lang"])


def _class_histogram(text: Column) -> Column:
    """Code points in each listed class and in none; plain small letters, most of a text, are dropped first."""

    def with_rest(counts: Column) -> Column:
        held = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.concat(counts, F.array(F.char_length(text).cast("long") - held))

    return let(F.regexp_replace(text, "[a-z]+", ""), lambda rest: let(F.array(*[_count(rest, m) for m in LISTED_CLASSES.values()]), with_rest))


def _word_histogram(reference: Column, words: Column, common: Column) -> Column:
    """Counts of the reference language's common words, then of all other words."""
    chosen = F.lit(None)
    for x, c in COMMON_WORDS.items():
        chosen = F.when(reference == x, F.array(*map(F.lit, c))).otherwise(chosen)
    counts = F.transform(chosen, lambda c: F.size(F.filter(common, lambda w: w == c)).cast("long"))
    return let(counts, lambda n: F.concat(n, F.array(F.size(words).cast("long") - F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x))))


def measures(text: Column, lang: Column) -> Column:
    """All that the rules need to know of a text, as a struct of some dozens of numbers."""

    def with_words(w: Column) -> Column:
        def with_common(c: Column) -> Column:
            return let(
                _reference_language(lang, c),
                lambda r: F.struct(
                    r.alias("reference"),
                    F.size(w).cast("long").alias("n_words"),
                    F.char_length(text).cast("long").alias("n_chars"),
                    _class_histogram(text).alias("classes"),
                    _word_histogram(r, w, c).alias("commons"),
                    _dup_lines(text).alias("n_dup_lines"),
                    _repeat_words(w).alias("n_repeat_words"),
                ),
            )

        return let(_common_of(w), with_common)

    return let(_words(text), with_words)


def measured(docs: DataFrame, keep: list[str], name: str, text_col: str = "text", lang: Column | None = None) -> DataFrame:
    """The columns ``keep`` and the measures of each text as a column ``name``; a null language is unknown."""
    own = F.lit(None).cast("string") if lang is None else lang
    text, said = free_name("__text", keep), free_name("__lang", keep)
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text_col).alias(text), own.alias(said))
    return slim.select(*[F.col(f"`{c}`") for c in keep], measures(F.col(text), F.col(said)).alias(name))


def fit_references(table: DataFrame, name: str, limits: Limits = Limits()) -> dict[str, dict[str, list[float]]]:
    """Each language's reference shares, from the measures of all documents of ``guard_words`` words and more.

    Character classes: the geometric mean of the documents' shares, which a minority of odd documents
    hardly moves.  Words: shares of the summed counts.  At most one row per known language comes to the
    driver, whatever the corpus' size.
    """
    n_class, n_word = len(LISTED_CLASSES) + 1, len(next(iter(COMMON_WORDS.values()))) + 1
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    logs = F.transform("classes", lambda c: F.ln((c + 0.5) / (total + 0.5 * n_class)))
    chosen = table.select(f"{name}.*").where(F.col("n_words") >= limits.guard_words)
    sums = (
        chosen.select("reference", "commons", logs.alias("logs"))
        .groupBy("reference")
        .agg(*[F.avg(F.col("logs")[i]).alias(f"c{i}") for i in range(n_class)], *[F.sum(F.col("commons")[i]).alias(f"w{i}") for i in range(n_word)])
    )
    found = {}
    for row in sums.collect():
        c, w = [math.exp(row[f"c{i}"]) for i in range(n_class)], [row[f"w{i}"] for i in range(n_word)]
        found[row["reference"]] = {"classes": [round(x / sum(c), 12) for x in c], "commons": [x / max(1, sum(w)) for x in w]}
    return found


def js_distance(counts: Column, shares: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of a histogram from reference shares; 0 for an empty one."""

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return (term(p) + term(q)) / 2

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    divergence = lambda n: F.aggregate(F.zip_with(counts, shares, lambda c, q: part(c / n, q)), F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda n: F.when(n == 0, F.lit(0.0)).otherwise(F.sqrt(F.greatest(divergence(n), F.lit(0.0)))))


def _shares(reference: Column, references: dict, kind: str) -> Column:
    out = F.lit(None).cast("array<double>")
    for x, r in references.items():
        out = F.when(reference == x, F.array(*[F.lit(float(v)) for v in r[kind]])).otherwise(out)
    return out


def verdict(measures: Column, references: dict, limits: Limits = Limits()) -> Column:
    """A struct of all counts, both distances, base_failed and kept, from a text's measures, each worked out once per row."""
    return let(measures, lambda m: _judged(m, references, limits))


def _judged(m: Column, references: dict, limits: Limits) -> Column:
    names = list(LISTED_CLASSES)

    def distance(kind: str) -> Column:
        """0 where the corpus has no document to make a reference of."""
        return F.coalesce(F.round(js_distance(m[kind], _shares(m["reference"], references, kind)), 9), F.lit(0.0))

    base = F.struct(
        m["n_words"].alias("n_words"),
        (m["n_chars"] - m["classes"][names.index("blank")]).alias("word_chars"),
        m["classes"][names.index("symbol")].alias("n_symbols"),
        m["n_dup_lines"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"),
        distance("classes").alias("class_distance"),
        distance("commons").alias("word_distance"),
    )

    def decide(b: Column) -> Column:
        failed = (b["n_words"] < limits.min_words) | (100 * b["n_repeat_words"] > limits.max_repeat_percent * b["n_words"])
        n, c, d = b["n_words"], b["class_distance"], b["word_distance"]
        far = (
            ((n >= limits.guard_words) & (c > limits.max_class_distance))
            | ((n >= limits.word_guard) & (d > limits.max_word_distance))
            | ((n >= limits.joint_guard) & (c > limits.joint_class_distance) & (d > limits.joint_word_distance))
        )
        return F.struct(
            b["n_words"].alias("n_words"),
            b["word_chars"].alias("word_chars"),
            b["n_symbols"].alias("n_symbols"),
            b["n_dup_lines"].alias("n_dup_lines"),
            b["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & ~far).alias("kept"),
            b["class_distance"].alias("class_distance"),
            b["word_distance"].alias("word_distance"),
        )

    return let(base, decide)


def score_documents(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", references: dict | None = None) -> DataFrame:
    """Counts, distances and verdict of every whole text, one row per row of ``docs``.

    A null text counts as empty: no words, so base_failed.  A null or unknown language is compared with the
    reference whose common words the text has most of, the first listed on a draw; there is none that fits
    a language without a list, so pass such documents' own references, or leave them to other rules.
    Repeated rows are judged alike; a null id is kept; an empty table gives no rows; other columns, of any
    name, are not read.  Very long texts are counted whole, in one row's memory and n log n time.  Texts are
    measured once, into a table of some dozens of numbers for each, from which references and verdicts
    come; no shuffle but for one row per language and task.
    """
    name = free_name("__measures", [id_col])
    table = measured(docs, [id_col], name, text_col, F.col(f"`{lang_col}`"))
    if references is None:
        with scratch(docs.sparkSession) as result:
            table = result(table, "rules-measures")
            references = fit_references(table, name, limits)
    return table.select(F.col(f"`{id_col}`"), verdict(F.col(name), references, limits).alias(name)).select(F.col(f"`{id_col}`"), f"{name}.*")


def keep_good(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", lang_col: str = "lang", references: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; nulls, repeats and empty tables as in :func:`score_documents`."""
    names = docs.columns
    name = free_name("__measures", names)
    table = docs.withColumn(name, measures(text_or_empty(text_col), F.col(f"`{lang_col}`")))
    if references is None:
        with scratch(docs.sparkSession) as result:
            # Rows and measures together: reading them again costs far less than measuring again.
            table = result(table, "rules-rows")
            references = fit_references(table, name, limits)
    return table.where(verdict(F.col(name), references, limits)["kept"]).select(*[F.col(f"`{c}`") for c in names])
