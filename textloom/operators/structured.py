"""Structured filters on a catalogue: a checked specification, its predicate, its count and its list."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTS = {"price_asc": ("price", True), "price_desc": ("price", False), "rating_desc": ("average_rating", False)}
MOST, USUAL = 50, 20


@dataclass(frozen=True)
class Filter:
    op: str = "list"
    price_min: float | None = None
    price_max: float | None = None
    rating_min: float | None = None
    store: str | None = None
    category: str | None = None
    sort: str | None = None
    limit: int = USUAL

    @staticmethod
    def of(given: dict) -> "Filter":
        """What given holds that is valid: numbers from text, text without outer blanks, known sorts, limits of 1 to MOST; the rest is left out."""

        def number(name):
            try:
                return float(given.get(name))
            except (TypeError, ValueError):
                return None

        def words(name):
            value = given.get(name)
            return value.strip() or None if isinstance(value, str) else None

        limit = number("limit")
        return Filter(
            op="count" if given.get("op") == "count" else "list", price_min=number("price_min"), price_max=number("price_max"), rating_min=number("rating_min"), store=words("store"), category=words("category"),
            sort=given["sort"] if given.get("sort") in SORTS else None, limit=USUAL if limit is None or not 1 <= limit else min(MOST, int(limit)),
        )

    def predicate(self) -> Column:
        terms = [F.lit(True)]
        for value, column, compare in ((self.price_min, "price", ">="), (self.price_max, "price", "<="), (self.rating_min, "average_rating", ">="), (self.store, "store", "="), (self.category, "category", "=")):
            if value is not None:
                c = F.col(column)
                terms.append(c >= value if compare == ">=" else c <= value if compare == "<=" else c == value)
        return reduce(lambda a, b: a & b, terms)


def answer(catalogue: DataFrame, spec: Filter, key: str) -> DataFrame:
    """(total) over the whole catalogue for a count; for a list its first rows, nulls last, ties by key."""
    kept = catalogue.where(spec.predicate())
    if spec.op == "count":
        return kept.agg(F.count("*").alias("total"))
    name, up = SORTS.get(spec.sort, (key, True))
    return kept.orderBy(F.col(name).asc_nulls_last() if up else F.col(name).desc_nulls_last(), key).limit(spec.limit)
