"""Column expressions with the meanings that questions, documents and answers need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(price: Column) -> Column:
    """An amount with two decimals, kept as a double, in whole cents; far cheaper than a cast to a decimal."""
    return F.rint(price * 100).cast("long")


def money(price: str, discount: str) -> Column:
    """Price less discount in whole ten-thousandths, so that a sum is exact and doesn't depend on the order of rows."""
    return (cents(F.col(price)) * (100 - cents(F.col(discount)))).cast("decimal(18,0)")


def amount(ten_thousandths: Column) -> Column:
    """A sum of money() as a double."""
    return (ten_thousandths * F.lit(0.0001).cast("decimal(4,4)")).cast("double")


def as_date(text: Column) -> Column:
    """The date of a text in date or date-time format; null for anything else."""
    return text.try_cast("date")


#: Directives of strftime and their counterparts in date patterns.
_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


def strftime(form: str, when: Column) -> Column:
    """SQLite's strftime for the directives above."""
    for directive, pattern in _STRFTIME.items():
        form = form.replace(directive, pattern)
    return F.date_format(when, form)


def julian_day(when: Column) -> Column:
    return F.datediff(when.cast("date"), F.lit("1970-01-01").cast("date")) + 2440587.5


def like(text: Column, pattern: str) -> Column:
    """LIKE without regard to case, as SQLite has it."""
    return text.ilike(pattern)


def total(x: Column) -> Column:
    """The sum as a double, 0.0 over no rows."""
    return F.coalesce(F.sum(x).cast("double"), F.lit(0.0))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case, each followed by its singular where it looks like a plural."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.flatten(F.transform(found, lambda t: F.when(singular(t) == t, F.array(t)).otherwise(F.array(t, singular(t)))))


def stems(text: Column) -> Column:
    """The set of a text's words in the singular."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, singular)))


def singular(token: Column) -> Column:
    """-ies becomes -y; -es, else -s, is cut off; only where at least three characters stand before the ending."""
    return (
        F.when(~token.endswith("s"), token)
        .when(token.rlike("^.{3,}ies$"), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("^.{3,}es$"), F.regexp_replace(token, "es$", ""))
        .when(token.rlike("^.{3,}s$"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def question_words(text: Column) -> Column:
    """Distinct words of a question without its closing "return ..." directive."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\breturn\b.*$", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(plain, "[^a-z0-9]+", " "), " "), lambda w: w != "")))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def cells_equal(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Equality of two texts as result cells: null only with null, numbers within tolerance, white space collapsed."""
    x, y = a.try_cast("double"), b.try_cast("double")
    collapsed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(collapsed(a) == collapsed(b))
