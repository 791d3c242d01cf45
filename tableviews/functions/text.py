"""Columns that write text: column lists, examples, templates, prompts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

PLACEHOLDER = r"\{(.*?)\}"
# Stand-ins for doubled braces while names are replaced.
OPEN_MARK, CLOSE_MARK = "\ue000", "\ue001"


def column_mentioned(sql: Column, column: Column, word: bool = False) -> Column:
    """Whether a SQL text uses a column name.

    The default is a plain substring test without case, which is what the usage
    profile is defined on; ``word`` asks for whole words.
    """
    if word:
        quoted = F.concat(F.lit(r"(?i)(^|\W)\Q"), column, F.lit(r"\E(\W|$)"))
        return F.rlike(sql, quoted)
    return F.contains(F.lower(sql), F.lower(column))


def percent_text(share: Column) -> Column:
    """0.5 as ``50.00%``; for printing only, keep the share itself for computing."""
    return F.format_string("%.2f%%", share * 100)


def column_line(column: Column, examples: Column) -> Column:
    """``name (a, b, c)``, or only the name when there are no examples."""
    return F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, F.concat(column, F.lit(" ("), F.array_join(examples, ", "), F.lit(")"))).otherwise(column)


def column_lines(columns: Column, examples: Column) -> Column:
    """One ``column_line`` per column; ``examples`` is MAP<STRING, ARRAY<STRING>>."""
    return F.array_join(F.transform(columns, lambda c: column_line(c, F.element_at(examples, c))), "\n")


def example_block(selected: Column, examples: Column, max_examples: int = 3) -> Column:
    """One line per column with examples; selected columns are marked."""
    filled = F.filter(F.map_entries(examples), lambda e: F.size(e["value"]) > 0)
    lines = F.transform(
        filled,
        lambda e: F.concat(
            F.when(F.array_contains(selected, e["key"]), "[SELECTED] ").otherwise(""),
            e["key"],
            F.lit(": "),
            F.array_join(F.slice(e["value"], 1, max_examples), ", "),
        ),
    )
    return F.array_join(lines, "\n")


def fill_prompt(template: Column, values: Mapping[str, Column]) -> Column:
    """Replace ``{name}`` by its value and doubled braces by single ones.

    Braces and names are first turned into private-use marks, so that values
    are never scanned for further names.
    """
    text = F.replace(F.replace(template, F.lit("{{"), F.lit(OPEN_MARK)), F.lit("}}"), F.lit(CLOSE_MARK))
    lookup = F.create_map(*[x for k, v in values.items() for x in (F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))])

    def unmark(piece: Column) -> Column:
        return F.replace(F.replace(piece, F.lit(OPEN_MARK), F.lit("{")), F.lit(CLOSE_MARK), F.lit("}"))

    pieces = F.split(text, r"(?=\{)|(?<=\})")
    filled = F.transform(pieces, lambda p: F.coalesce(F.element_at(lookup, p), unmark(p)))
    return F.array_join(filled, "")


def placeholders(template: Column) -> Column:
    """Names in braces, in order of appearance."""
    return F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))


def template_fits(template: Column, columns: Column) -> Column:
    """Whether a template names exactly the given columns."""
    return F.array_sort(F.array_distinct(placeholders(template))) == F.array_sort(F.array_distinct(columns))


def fill_template(template: Column, names: Column, values: Column, missing: str = "keep") -> Column:
    """Replace every ``{name}`` by the value at the same place of ``values``.

    Names are replaced one after the other, so a value that itself contains
    ``{other}`` is filled by the later name.  Where a value is missing the
    placeholder stays (``keep``) or becomes ``[name=NA]`` (``mark``).
    """
    def step(acc: Column, pair: Column) -> Column:
        hole = F.concat(F.lit("{"), pair["name"], F.lit("}"))
        absent = hole if missing == "keep" else F.concat(F.lit("["), pair["name"], F.lit("=NA]"))
        return F.replace(acc, hole, F.coalesce(pair["value"], absent))

    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    return F.aggregate(pairs, template, step)


def token_estimate(n_chars: Column, chars_per_token: float = 4.0) -> Column:
    """Rough number of tokens of a text of the given length."""
    return F.ceil(n_chars / F.lit(chars_per_token)).cast("bigint")
