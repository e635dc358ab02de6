"""Column functions of cells that hold several lines: sizes told by machines and people, and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions.text import empty

#: Lines that a machine wrote: figures alone, or with the day or months that they hold for (fixed values).
FIGURES, ON_DAY, MONTHS = r"^\s*[\d,\.\s]{1,15}\s*$", r"\(\d{4}-\d{2}-\d{2} 기준\)\s*$", r"\(최근 \d+개월(?: \d+건)?\)\s*$"
#: A part of a text that may be an address (fixed value).
PART = r"""([^\s,·()<>"']+\.[^\s,·()<>"']+)"""


def by_machine(line: Column) -> Column:
    """Whether a line may be replaced by a newer figure; sentences of people may not."""
    return (F.trim(line) != "") & (line.rlike(FIGURES) | line.rlike(ON_DAY) | line.rlike(MONTHS))


def with_figure(held: Column, line: Column) -> Column:
    """held with line in place of its first machine's line, or on top if it has none; as it is if it has the line, or line is blank."""
    old, new = F.trim(empty(held)), F.trim(empty(line))
    lines = F.transform(F.split(old, "\n"), lambda x: F.rtrim(x))
    # Places count from 1; 0: no machine's line.
    first = F.array_position(F.transform(lines, lambda x: by_machine(x)), True)
    replaced = F.transform(lines, lambda x, k: F.when(k + 1 == first, new).otherwise(x))
    merged = F.when(first > 0, replaced).otherwise(F.concat(F.array(new), lines))
    same = F.exists(lines, lambda x: F.trim(x) == new)
    return F.when((new == "") | same, old).when(old == "", new).otherwise(F.trim(F.array_join(merged, "\n")))


def address_key(part: Column) -> Column:
    """What tells addresses apart: without scheme, closing slashes, brackets around points and case."""
    plain = F.replace(F.lower(F.trim(empty(part))), F.lit("[.]"), F.lit("."))
    return F.regexp_replace(F.regexp_replace(plain, r"^[a-z][a-z0-9+.-]*://", ""), "/+$", "")


def address_parts(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(empty(text), F.lit(PART)), lambda p: p.rlike("(?i)[a-z]"))


def with_addresses(held: Column, more: Column) -> Column:
    """held with a line for each line of more that has addresses held has not, these joined by dots; each once. A blank held: more itself."""
    old, new = F.trim(empty(held)), F.trim(empty(more))
    known = F.transform(address_parts(old), lambda p: address_key(p))
    start = F.struct(known.alias("known"), F.array().cast("array<string>").alias("lines"))

    def add_line(seen: Column, line: Column) -> Column:
        begin = F.struct(seen.known.alias("known"), F.array().cast("array<string>").alias("parts"))

        def add(state: Column, part: Column) -> Column:
            key = address_key(part)
            fresh = (key != "") & ~F.array_contains(state.known, key)
            return F.when(fresh, F.struct(F.array_append(state.known, key).alias("known"), F.array_append(state.parts, part).alias("parts"))).otherwise(state)

        found = F.aggregate(address_parts(line), begin, add)
        lines = F.when(F.size(found.parts) > 0, F.array_append(seen.lines, F.array_join(found.parts, " · "))).otherwise(seen.lines)
        return F.struct(found.known.alias("known"), lines.alias("lines"))

    added = F.aggregate(F.split(new, "\n"), start, add_line).lines
    return F.when(new == "", old).when(old == "", new).when(F.size(added) > 0, F.concat_ws("\n", old, F.array_join(added, "\n"))).otherwise(old)
