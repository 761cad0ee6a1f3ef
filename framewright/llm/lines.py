"""Line-level dedup by winnowing, in DataFrame expressions only.

Lines with a word are hashed, and two in a row make a gram.  Of every window of two grams, which is a run
of three lines, the minimum is selected, so each run of three lines has a fingerprint that all its copies
share.  Fingerprints found more than once are extended by the line before or after to the windows that
selected them; a run so restored meets its own first position in the corpus, and all later ones go.  Runs
of one or two lines that are long enough by themselves are fingerprints always, and need no extension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, let, scratch, stage_out, text_or_empty

MIN_LINES = 3
MIN_WORDS = 50
BLANKS = "\x20\t\n\x0b\x0c\r"


def _has_word(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS)) != ""


def _n_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per fingerprint: fp, the document's key (id, th: hash of the text), pos, n, before, after, whole.

    ``pos`` counts lines with a word from 0; ``n`` is how many lines the fingerprint covers.  ``before`` and
    ``after`` are hashes of the neighbours towards which a window selected it, null where none did;
    ``whole`` says that its lines have ``min_words`` words, so that it is a run by itself.
    """
    text = text_or_empty(text_col)
    content = F.filter(F.split(text, "\n"), _has_word)
    hashed = F.transform(content, lambda x: F.struct(F.xxhash64(x).alias("h"), _n_words(x).alias("w")))

    def chosen(hs: Column) -> Column:
        h = lambda i: F.get(hs, i)["h"]
        w = lambda i: F.get(hs, i)["w"]
        starts = F.when(F.size(hs) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(hs) - 2))

        def pairs(grams: Column) -> Column:
            # The later of equal grams wins a window; there is no window before the first gram or after the last.
            before = lambda g, i: F.when((i > 0) & (g <= F.get(grams, i - 1)), h(i - 1))
            after = lambda g, i: F.when(g < F.get(grams, i + 1), h(i + 2))
            return F.transform(grams, lambda g, i: F.struct(g.alias("fp"), i.alias("pos"), F.lit(2).alias("n"), before(g, i).alias("before"), after(g, i).alias("after"), (w(i) + w(i + 1) >= min_words).alias("whole")))

        two = let(F.transform(starts, lambda i: F.xxhash64(h(i), h(i + 1))), pairs)
        none = F.lit(None).cast("long")
        one = F.transform(hs, lambda x, i: F.struct(F.xxhash64(x["h"]).alias("fp"), i.alias("pos"), F.lit(1).alias("n"), none.alias("before"), none.alias("after"), (x["w"] >= min_words).alias("whole")))
        return F.filter(F.concat(two, one), lambda x: x["whole"] | x["before"].isNotNull() | x["after"].isNotNull())

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), hashed.alias("hs"))
    return slim.select("id", "th", F.explode(let(F.col("hs"), chosen)).alias("f")).select("f.fp", "id", "th", "f.pos", "f.n", "f.before", "f.after", "f.whole")


def _extended(prints: DataFrame) -> DataFrame:
    """The runs that fingerprints stand for: fp, side and neighbour name one, id, th, pos and n place it."""
    here = F.when(F.col("whole"), F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("neighbour"), F.col("pos").alias("pos"), F.col("n").alias("n")))
    up = F.when(F.col("before").isNotNull(), F.struct(F.lit(-1).alias("side"), F.col("before").alias("neighbour"), (F.col("pos") - 1).alias("pos"), (F.col("n") + 1).alias("n")))
    down = F.when(F.col("after").isNotNull(), F.struct(F.lit(1).alias("side"), F.col("after").alias("neighbour"), F.col("pos").alias("pos"), (F.col("n") + 1).alias("n")))
    return prints.select("fp", "id", "th", F.explode(F.filter(F.array(here, up, down), lambda x: x.isNotNull())).alias("r")).select("fp", "r.side", "r.neighbour", "id", "th", "r.pos", "r.n")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Positions to delete, per document key: id, th, drop (sorted line positions, lines with a word counted from 0)."""
    with scratch(docs.sparkSession) as result:
        prints = stage_out(fingerprints(docs, id_col, text_col, min_words), "line-prints")
        repeated = stage_out(prints.groupBy("fp").agg(F.count("*").alias("times")).where("times > 1").select("fp"), "line-repeated")
        runs = stage_out(_extended(prints.join(repeated.hint("merge"), "fp")), "line-runs")
        run, place = ["fp", "side", "neighbour"], F.struct("id", "th", "pos")
        first = stage_out(runs.groupBy(*run).agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"), "line-first")
        later = runs.join(first.hint("merge"), run).where(~place.eqNullSafe(F.col("first")))
        gone = later.select("id", "th", F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("pos")).distinct()
        return result(gone.groupBy("id", "th").agg(F.sort_array(F.collect_list("pos")).alias("drop")), "line-drops")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted, and two more columns, named by ``counts``: lines with a word, and how many went.

    A run is three lines or more, or fewer with at least ``min_words`` words; lines without a word do not
    count.  A line is deleted exactly if it is in a run that stands at an earlier position too: documents in
    order of id, those of one id in order of their hash, lines in order of place.  So one copy of every run
    stays.  Rows with the same id and the same text count as one document and come out alike.
    Null texts stay null (no lines); lines without a word neither match nor break a run and stay; a null
    id comes first; an empty table gives no rows.  Work on one text grows with its lines, whatever its
    length.  All columns are kept; the new ones replace columns of their name, in whatever case.  Lines and
    grams are compared by hashes of 64 bits.  Fingerprints that a third of all documents share meet only
    in map-side counts and minima, and in joins whose skewed side the adaptive planner splits.  Those are
    merge joins at any size: what they join with grows with the corpus.
    """
    names = [c for c in docs.columns if c.lower() not in {x.lower() for x in counts}]
    key, other, th, drop = (free_name(c, names) for c in ("__key", "__id", "__th", "__drop"))
    drops = repeated_lines(docs, id_col, text_col, min_words).withColumnsRenamed({"id": other, "th": th, "drop": drop})
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(text_or_empty(text_col)).alias(key))
    both = keyed.join(drops.hint("merge"), F.col(f"`{id_col}`").eqNullSafe(F.col(other)) & (F.col(key) == F.col(th)), "left")

    def rest(lines: Column) -> Column:
        content = F.filter(F.transform(lines, lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull())
        gone = let(content, lambda c: F.transform(drop, lambda p: F.get(c, p)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    text = F.col(f"`{text_col}`")
    lines = F.split(text, "\n")
    changed = F.when(F.col(drop).isNull(), text).otherwise(let(lines, rest))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(lines, _has_word))).cast("long")
    return both.select(
        *[changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        n_lines.alias(counts[0]),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(counts[1]),
    )
