"""Search plans: query strings composed from requests, and budgets over their combinations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quoted(words: Column) -> Column:
    """Terms of several words in quotes."""
    return F.transform(words, lambda w: F.when(w.contains(" "), F.concat(F.lit('"'), w, F.lit('"'))).otherwise(w))


OPERATORS = frozenset({"phrase", "or", "exclude", "site", "in_title"})


def composed(required: Column, any_of: Column, exclude: Column, site: Column, most_words: int = 32, phrases: Column | None = None, in_title: Column | None = None, operators: frozenset[str] = OPERATORS) -> Column:
    """A query string, or null where it is longer than the surface takes or asks for what the surface has no operator for.

    Phrases in quotes whatever their length, required terms, the alternatives in parentheses,
    excluded ones with a minus, words of the title, and the site.
    """
    none = F.array().cast("array<string>")
    phrases, in_title = (F.coalesce(x, none) if x is not None else none for x in (phrases, in_title))
    whole = F.transform(phrases, lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit("")), F.lit('"')))
    asked = {"phrase": F.size(phrases) > 0, "or": F.size(F.coalesce(any_of, none)) > 1, "exclude": F.size(F.coalesce(exclude, none)) > 0, "site": site.isNotNull(), "in_title": F.size(in_title) > 0}
    refused = F.lit(False)
    for name, has in asked.items():
        refused = refused | (has if name not in operators else F.lit(False))
    any_ = quoted(F.coalesce(any_of, none))
    parts = F.concat(
        whole,
        quoted(F.coalesce(required, none)),
        F.when(F.size(any_) > 1, F.array(F.concat(F.lit("("), F.array_join(any_, " OR "), F.lit(")")))).otherwise(any_),
        F.transform(quoted(F.coalesce(exclude, none)), lambda w: F.concat(F.lit("-"), w)),
        F.transform(quoted(in_title), lambda w: F.concat(F.lit("intitle:"), w)),
        F.when(site.isNotNull(), F.array(F.concat(F.lit("site:"), site))).otherwise(none),
    )
    text = F.array_join(parts, " ")
    return F.when(~refused & (F.size(F.split(text, " ")) <= most_words), text)


def url(base: Column, params: dict[str, Column]) -> Column:
    """A base with its non-null parameters, encoded, in the order given."""
    pairs = F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(k + "="), F.url_encode(v))) for k, v in params.items())))
    return F.concat(base, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit("")))


def recent(queries: DataFrame, text: str, at: str, most: int = 20) -> DataFrame:
    """The latest of equal queries only, newest first, ``most`` at most."""
    return queries.groupBy(text).agg(F.max(at).alias(at)).orderBy(F.desc(at), text).limit(most)


def within_budget(plan: DataFrame, part: str, order: list[Column], budget: int) -> DataFrame:
    """The first ``budget`` rows of each part, and how many were dropped beside each."""
    w = Window.partitionBy(part)
    return plan.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("dropped", F.greatest(F.lit(0), F.count("*").over(w) - budget)).where(F.col("rank") <= budget)


def carried(plan: DataFrame, base: str, base_order: list[Column], order: list[Column], budget: int, engines: list[str]) -> DataFrame:
    """``plan`` with place, planned, engine and dropped: one budget spent on the bases in their order, each on its rows in theirs.

    What a base leaves over goes to the next one; engines take turns over all planned rows, so
    each base begins with the one after the last base's last. ``dropped`` is how many of the base's rows
    found no budget. Bases meet as a row each with their counts; their rows are only ordered within.
    """
    sizes = plan.groupBy(base).agg(F.count("*").alias("_size"), F.min(F.struct(*base_order)).alias("_order"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_order", base).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spent = sizes.select(F.col(base).alias("_base"), "_size", before.alias("_before"))
    rows = plan.join(spent, F.col(base).eqNullSafe(F.col("_base"))).withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy(base).orderBy(*order)))
    planned = F.col("place") <= budget
    turn = F.element_at(F.array(*map(F.lit, engines)), ((F.col("place") - 1) % len(engines) + 1).cast("int")) if engines else F.lit(None).cast("string")
    dropped = F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), F.col("_before") + F.col("_size") - budget))
    return rows.select(*plan.columns, "place", planned.alias("planned"), F.when(planned, turn).alias("engine"), dropped.alias("dropped"))


def automation_url(base: str, query: Column, location: Column, date_param: str, date_format: str, codes: dict[str, str], date_range: Column) -> Column:
    """The URL that automated discovery sends: query and location, and the date restriction where the surface has a code for it."""
    code = F.element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), date_range)
    before, after = date_format.split("{code}")
    return url(F.lit(base), {"q": query, "l": location, date_param: F.when(code.isNotNull(), F.concat(F.lit(before), code, F.lit(after)))})


@dataclass(frozen=True)
class Surface:
    """A search surface: its name, its link's base, and which restrictions its typed form has (none: no typed form)."""

    name: str
    base: str
    operators: tuple[str, ...]


def composed_both(requests: DataFrame, surfaces: list[Surface]) -> DataFrame:
    """``requests`` (surface, required, exclude) with text, url and note.

    A restriction that a surface cannot express stops both, with a note; a surface without a
    typed form takes the plain words in its link.
    """
    text, link, note = (F.lit(None).cast("string") for _ in range(3))
    for s in surfaces:
        own = F.col("surface") == s.name
        typed = composed(F.col("required"), F.array().cast("array<string>"), F.col("exclude"), F.lit(None).cast("string"))
        plain = F.array_join("required", " ")
        refused = (F.size("exclude") > 0) if "exclude" not in s.operators else F.lit(False)
        query = typed if s.operators else plain
        text = F.when(own, typed if s.operators else F.lit(None).cast("string")).otherwise(text)
        link = F.when(own & ~refused, url(F.lit(s.base), {"q": query})).when(own, F.lit(None).cast("string")).otherwise(link)
        note = F.when(own, F.when(refused, "unexpressible").otherwise("" if s.operators else "no typed form")).otherwise(note)
    return requests.withColumn("text", text).withColumn("url", link).withColumn("note", note)
