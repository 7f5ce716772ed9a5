"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Bounded to [low, high]; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c.cast("double"))))


def round4(c: Column) -> Column:
    """To 4 places, half up: a billionth is added, so that a half that binary doubles can't hold isn't lost."""
    return F.round(c + 1e-9, 4)


def in_order(value: str, *order: str, sep: str | None = ",") -> Column:
    """An aggregate: the values of a group in the order of other columns, joined (or an array without sep)."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("v"))))
    values = F.transform(rows, lambda r: r["v"])
    return values if sep is None else F.array_join(values, sep)


def norm_text(c: Column | str) -> Column:
    """For skill matching: lower case, `/` and other than a-z 0-9 + # . to space, spaces collapsed, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9+#.\\s]", " "), "\\s+", " "))


def norm_name(c: Column | str) -> Column:
    """A skill's name: trimmed, lower case, spaces collapsed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), "\\s+", " "))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(c), "\\s+"), lambda w: w != ""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """The version 5 UUID of a name, native: SHA-1 with the version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.conv((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 8).cast("string"), 10, 16)
    return F.lower(
        F.concat_ws(
            "-",
            F.substring(digest, 1, 8),
            F.substring(digest, 9, 4),
            F.concat(F.lit("5"), F.substring(digest, 14, 3)),
            F.concat(variant, F.substring(digest, 18, 3)),
            F.substring(digest, 21, 12),
        )
    )


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by a fold over a's characters of the table's row over b's."""
    xs, ys = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    start = F.array_repeat(F.lit(0), F.size(ys) + 1)

    def step(row: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            best = F.when(F.element_at(ys, j.cast("int")) == x, F.element_at(row, j.cast("int")) + 1).otherwise(F.greatest(F.element_at(row, (j + 1).cast("int")), F.element_at(acc, -1)))
            return F.concat(acc, F.array(best))

        return F.when(F.size(ys) == 0, row).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ys), F.lit(1))), F.array(F.lit(0)), cell))

    return F.element_at(F.aggregate(xs, start, step), -1)


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (|a| + |b|), 1 for two empty texts."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * lcs_length(a, b) / total)


def windows(text: Column, pattern: Column | str, before: int, after: int, most: int = 12) -> Column:
    """An array of what stands around each of the first `most` hits of the pattern, by offsets from split and extract."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits, gaps = F.slice(F.regexp_extract_all(text, pattern, F.lit(0)), 1, most), F.slice(F.split(text, pattern, -1), 1, most)

    def place(done: Column, pair: Column) -> Column:
        start = done["end"] + F.length(pair["gap"])
        return F.struct(F.concat(done["at"], F.array(start)).alias("at"), (start + F.length(pair["hit"])).alias("end"))

    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    at = F.aggregate(pairs, F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("end")), place)["at"]
    return F.zip_with(at, hits, lambda s, h: F.substr(text, F.greatest(s - before, F.lit(0)) + 1, F.least(s, F.lit(before)) + F.length(h) + after))
