"""What is in the payload of an action, what a row is about, and small vectors of features."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens of a program's text; each is a token itself.
DELIMITERS = (" ", "\t", "\n", "(", ")", "[", "]", "{", "}", ":", ",", ".", "+", "-", "*", "/", "%", "=", "<", ">", "!", '"', "'", "#")


def as_string(data: Column) -> Column:
    """A payload that is one JSON string, without its quotes."""
    return F.regexp_replace(data, '^"|"$', "")


def block_id(data: Column) -> Column:
    """The id of a block: the field ``id``, which may itself hold an object with an id."""
    return F.coalesce(F.get_json_object(data, "$.id.id"), F.get_json_object(data, "$.id"))


def field_of(data: Column, name: str) -> Column:
    return F.get_json_object(data, f"$.{name}")


def selector_of(data: Column) -> Column:
    return F.coalesce(F.get_json_object(data, "$.id.selector"), F.get_json_object(data, "$.selector"))


def hint_text(texts: Column) -> Column:
    """The child types of a hint as shown: calls of own blocks by one name, without a leading prototype."""
    named = F.transform(texts, lambda x: F.when(x == "doCustomBlock", "evaluateCustomBlock").otherwise(x))
    return F.when(F.element_at(named, 1) == "prototypeHatBlock", F.slice(named, 2, F.size(named))).otherwise(named)


def ordering_label(path: Column, ignored: Sequence[str] = (), n: int = 3) -> Column:
    """The last types of a node's path that aren't ignored."""
    kept = F.filter(path, lambda x: ~x.isin(list(ignored))) if ignored else path
    return F.array_join(F.slice(kept, F.greatest(F.size(kept) - n + 1, F.lit(1)), n), "->")


def location(places: Column) -> Column:
    """Tree:i:j, the places of a node and its ancestors among their siblings, from the root down."""
    return F.concat_ws(":", F.lit("Tree"), F.array_join(F.transform(places, lambda x: x.cast("string")), ":"))


def tokens(source: str, delimiters: Sequence[str] = DELIMITERS) -> list[str]:
    """The tokens of a program's text with the delimiters among them; no token is empty."""
    cut = re.compile("(" + "|".join(re.escape(d) for d in delimiters) + ")")
    return [x for x in cut.split(source) if x]


def tokens_col(source: Column, delimiters: Sequence[str] = DELIMITERS) -> Column:
    """The same of a column, JVM-side."""
    some = "".join(re.escape(d) for d in delimiters)
    return F.regexp_extract_all(source, F.lit(f"[{some}]|[^{some}]+"), 0)


def joined(a: Column, b: Column) -> Column:
    """Features of either of two vectors of booleans."""
    return F.zip_with(a, b, lambda x, y: x | y)


def matches(a: Column, b: Column) -> Column:
    """How many features two vectors have in common."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x & y), lambda x: x))


def alike(a: Column, b: Column) -> Column:
    """Common features over features of either, 1 if there are none."""
    either = F.size(F.filter(joined(a, b), lambda x: x))
    return F.when(either > 0, matches(a, b) / either).otherwise(1.0)


def count_of(items: Column, item: Column) -> Column:
    return F.size(F.filter(items, lambda x: x == item))


def bag_difference(a: Column, b: Column) -> Column:
    """Tokens, with multiplicity, that only one of two bags has."""
    n = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_distinct(F.concat(a, b)), F.lit(0), lambda acc, t: acc + F.abs(n(a, t) - n(b, t)))
