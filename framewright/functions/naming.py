"""File names, path parts, format and option tokens as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a SELECT text may not hold, as whole words in any case (fixed values).
FORBIDDEN_SQL = ["INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "REPLACE", "ATTACH", "DETACH", "PRAGMA", "REINDEX", "VACUUM"]
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff"]


def file_name(path: Column) -> Column:
    """The last part of a path that is a name; null where there is none."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(last != "..", last)


def file_stem(path: Column) -> Column:
    """The file name without what follows its last dot; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null without one."""
    found = F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(file_name(path).rlike(r"^.+\.[^.]*$"), found)


def path_key(path: Column) -> Column:
    """Sorts paths part by part, not by the bytes of the whole string."""
    return F.split(path, "/")


def suffixed(name: Column, suffix: Column) -> Column:
    """``suffix`` before the last dot, or at the end without one."""
    dot = F.length(name) - F.length(F.substring_index(name, ".", -1))
    return F.when(~F.contains(name, F.lit(".")), F.concat(name, suffix)).otherwise(F.concat(F.substr(name, F.lit(1), dot - 1), suffix, F.substr(name, dot)))


def crop_filename(stem: Column, index: Column, width: Column, height: Column, ext: Column, timestamp: Column, template: Column, quality_suffix: Column) -> Column:
    """The name of a crop: a template's variables are replaced one after the other, so a stem may hold later ones.

    ``index`` counts from 0 and is shown from 1.  A null template gives ``{stem}_face{n}.{ext}``.
    """
    name = template
    number = (index + 1).cast("string")
    for key, value in (("original", stem), ("index", number), ("width", width.cast("string")), ("height", height.cast("string")), ("ext", ext), ("timestamp", timestamp.cast("string"))):
        name = F.replace(name, F.lit("{" + key + "}"), value)
    name = F.when(F.contains(template, F.lit("{ext}")), name).otherwise(F.concat(name, F.lit("."), ext))
    plain = F.concat(stem, F.lit("_face"), number, F.lit("."), ext)
    return suffixed(F.when(template.isNull(), plain).otherwise(name), F.coalesce(quality_suffix, F.lit("")))


def padded_filename(stem: Column, number: Column, ext: Column) -> Column:
    """Two digits at least; larger numbers take as many as they need."""
    return F.concat(stem, F.format_string("_face_%02d.", number.cast("long")), ext)


def safe_parts(path: Column) -> Column:
    """The parts of a path that are names: no root, no dots."""
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))


def safe_path(path: Column) -> Column:
    return F.array_join(safe_parts(path), "/")


def override_path(output_dir: Column, target: Column, ext: Column, index: Column, multi: Column) -> Column:
    """Where a crop with a given target goes; never outside ``output_dir``."""
    parts = safe_parts(target)
    parent = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    stem = F.coalesce(F.nullif(file_stem(F.array_join(parts, "/")), F.lit("")), F.lit("output"))
    name = F.concat(stem, F.when(multi, F.concat(F.lit("_face"), (index + 1).cast("string"))).otherwise(""), F.lit("."), F.regexp_replace(ext, r"^\.+", ""))
    return F.array_join(F.concat(F.array(output_dir), parent, F.array(name)), "/")


def normal_extension(ext: Column) -> Column:
    e = F.lower(ext)
    return F.when(e == "jpeg", "jpg").when(e == "tiff", "tif").otherwise(e)


def image_format(token: Column) -> Column:
    """png, jpeg, webp, tiff, bmp or avif; null for anything else."""
    t = F.lower(token)
    return F.when(t.isin("png", "webp", "bmp", "avif"), t).when(t.isin("jpg", "jpeg"), "jpeg").when(t.isin("tif", "tiff"), "tiff")


def output_format(path: Column, option: Column, auto_detect: Column) -> Column:
    """The destination's own format if it is to be detected and known, else the option's, else png."""
    return F.coalesce(F.when(auto_detect, image_format(extension(path))), image_format(option), F.lit("png"))


def png_compression(token: Column) -> Column:
    t = F.lower(F.trim(token))
    return F.when(t.isin("fast", "best"), t).when(t.rlike(r"^\+?0*[0-3]$"), "fast").when(t.rlike(r"^\+?0*[7-9]$"), "best").otherwise("default")


def mapping_format(path: Column) -> Column:
    """The kind of a mapping table by its extension."""
    e = F.lower(F.coalesce(extension(path), F.lit("")))
    return F.when(e.isin("xlsx", "xls", "xlsm", "ods"), "excel").when(e.isin("parquet", "pq"), "parquet").when(e.isin("db", "sqlite", "sqlite3"), "sqlite").otherwise("csv")


def mapping_format_token(token: Column) -> Column:
    """The kind that an option names; null for an unknown one."""
    t = F.lower(F.trim(token))
    return (
        F.when(t.isin("csv", "delimited", "text"), "csv").when(t.isin("excel", "xlsx", "xls"), "excel").when(t.isin("parquet", "pq"), "parquet").when(t.isin("sqlite", "sql", "db"), "sqlite")
    )


def positioning_mode(token: Column) -> Column:
    t = F.lower(F.trim(token))
    return F.when(t.isin("rule_of_thirds", "ruleofthirds", "rule-of-thirds", "thirds"), "rule_of_thirds").when(t == "custom", "custom").otherwise("center")


def telemetry_level(token: Column) -> Column:
    t = F.lower(F.trim(token))
    return F.when(t.isin("off", "error", "warn", "info", "trace"), t).when(t == "warning", "warn").otherwise("debug")


def status_badge(status: Column, exported: Column) -> Column:
    """Short label of a batch status; completed without any export counts as skipped."""
    s = F.lower(status)
    return (
        F.when(s == "processing", "run")
        .when((s == "completed") & (exported > 0), "ok")
        .when(s.isin("completed", "skipped"), "skip")
        .when(s == "failed", "err")
        .otherwise("—")
    )


def is_safe_select(sql: Column) -> Column:
    """Whether a text is one SELECT without a semicolon or a forbidden word; an underscore bounds a word."""
    t = F.upper(F.trim(sql))
    words = "(?<![A-Z0-9])(" + "|".join(FORBIDDEN_SQL) + ")(?![A-Z0-9])"
    return t.startswith("SELECT") & ~F.contains(t, F.lit(";")) & ~t.rlike(words)


def check_select(sql: str) -> str:
    """The text itself if :func:`is_safe_select` holds for it, else a ValueError that says why not."""
    t = sql.strip().upper()
    if not t.startswith("SELECT"):
        raise ValueError("only SELECT queries are allowed")
    if ";" in t:
        raise ValueError("a query may not hold a semicolon")
    if m := re.search("(?<![A-Z0-9])(" + "|".join(FORBIDDEN_SQL) + ")(?![A-Z0-9])", t):
        raise ValueError(f"forbidden word in query: {m[1]}")
    return sql


def quoted(name: str, mark: str = '"') -> str:
    return mark + name.replace(mark, mark * 2) + mark
