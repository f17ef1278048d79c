"""Prompts and the checks of their answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_final(word: Column) -> Column:
    """Whether the last syllable of a Korean word ends in a consonant; false for other words."""
    code = F.ascii(F.right(word, F.lit(1)))
    return code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 != 0)


def particle(word: Column, after_consonant: str, after_vowel: str) -> Column:
    """The word with the particle that its ending asks for."""
    return F.concat(word, F.when(has_final(word), after_consonant).otherwise(after_vowel))


def build(head: Column, field: Column, rule: Column, tail: Column) -> Column:
    """Head with the field's name put in, rule and tail; blank parts are left out."""
    named = F.replace(head, F.lit("{field}"), field)
    return F.array_join(F.filter(F.array(named, rule, tail), lambda p: F.trim(F.coalesce(p, F.lit(""))) != ""), "\n")


def judge(answer: Column, expected: Column) -> dict[str, Column]:
    """first_ok: the first number is the expected one; only_one: it is the only
    number; table_lines and other_lines of the answer."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit("[0-9][0-9,]*"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    lines = F.filter(F.split(answer, "\n"), lambda x: F.trim(x) != "")
    table = F.size(F.filter(lines, lambda x: F.trim(x).startswith("|")))
    return {
        "first_ok": F.coalesce(F.get(numbers, F.lit(0)) == expected.cast("string"), F.lit(False)), "only_one": F.size(numbers) == 1,
        "table_lines": table, "other_lines": F.size(lines) - table,
    }


def items_only(items: Column) -> Column:
    """A line "name qty amount" for each named item; null without any."""
    named = F.filter(items, lambda i: F.coalesce(i["name"], F.lit("")) != "")
    lines = F.transform(named, lambda i: F.trim(F.concat_ws(" ", i["name"], i["qty"].cast("string"), i["amount"].cast("string"))))
    return F.when(F.size(named) > 0, F.array_join(lines, "\n"))


def json_fields(fields: Column, keys: tuple[str, ...], items: Column | None = None) -> Column:
    """A JSON object with exactly these keys, null where a field is missing or empty."""
    parts = [F.nullif(fields[k], F.lit("")).alias(k) for k in keys]
    if items is not None:
        parts.append(items.alias("items"))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
