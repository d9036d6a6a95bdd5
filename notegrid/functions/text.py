"""Suggestions and similarity of short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score floor for containment, default threshold and number of results.
CONTAINMENT_FLOOR, FUZZY_THRESHOLD, FUZZY_LIMIT = 0.6, 0.5, 10


def _nearest(v: Column, options: Column, limit) -> Column:
    scored = F.transform(options, lambda o, i: F.struct(
        F.levenshtein(v, F.lower(o)).alias("d"), i.alias("i"), o.alias("o")))
    return F.array_min(F.filter(scored, lambda s: s["d"] <= limit(s["o"])))["o"]


def suggest_option(value: Column, options: Column) -> Column:
    """Closest declared option: equal ignoring case, prefix, containment, then edits up to 40 %
    of the longer text; the first in declared order wins."""
    v = F.lower(value)
    same = F.filter(options, lambda o: F.lower(o) == v)
    prefix = F.filter(options, lambda o: F.startswith(F.lower(o), v))
    inside = F.filter(options, lambda o: F.contains(F.lower(o), v) | F.contains(v, F.lower(o)))
    near = _nearest(v, options, lambda o: F.ceil(F.greatest(F.length(value), F.length(o)) * 0.4))
    return F.coalesce(F.get(same, 0), F.get(prefix, 0), F.get(inside, 0), near)


def suggest_key(value: Column, known: Column) -> Column:
    """Closest declared field name: equal ignoring case, then at most min(2, 40 %) edits."""
    v = F.lower(value)
    same = F.filter(known, lambda o: F.lower(o) == v)
    near = _nearest(v, known, lambda o: F.least(F.lit(2).cast("bigint"), F.ceil(F.length(o) * 0.4)))
    return F.coalesce(F.get(same, 0), near)


def bare_key(key: Column) -> Column:
    """A field name without case and without blanks, dashes and underscores."""
    return F.regexp_replace(F.lower(key), r"[\s\-_]+", "")


def singular_plural(a: Column, b: Column) -> Column:
    """One bare name is the other with an s; neither is empty."""
    return (a != "") & (b != "") & ((a == F.concat(b, F.lit("s"))) | (b == F.concat(a, F.lit("s"))))


def similar_keys(key: Column, fits, fields: Column, limit: int = 3) -> Column:
    """Names among ``fields`` (array of struct with name) that an unknown key may stand for.

    Bare names may differ by a fifth of the shorter one, at least by one edit. Same bare name comes
    first, then singular or plural, then the rest; then fields the value ``fits``, fewer edits, the name.
    """
    own = bare_key(key)

    def judged(f: Column) -> Column:
        name = bare_key(f["name"])
        kind = F.when(name == own, 0).when(singular_plural(own, name), 1).otherwise(2)
        return F.struct(kind.alias("kind"), (~fits(f)).alias("misfit"), F.levenshtein(own, name).alias("edits"),
                        f["name"].alias("name"), F.least(F.length(own), F.length(name)).alias("shorter"))

    open_to = F.filter(fields, lambda f: (f["name"] != "type") & ~F.endswith(f["name"], F.lit("-type")) & (bare_key(f["name"]) != ""))
    near = F.filter(F.transform(open_to, judged), lambda j: j["edits"] <= F.greatest(F.lit(1), F.floor(j["shorter"] / 5)))
    ranked = F.slice(F.array_sort(near), 1, limit)
    return F.when(own != "", F.transform(ranked, lambda j: j["name"])).otherwise(F.array().cast("array<string>"))


def similarity(query: Column, candidate: Column) -> Column:
    """1 when equal, else 1 - distance / longer length, at least 0.6 when one holds the other."""
    a, b = F.lower(F.trim(query)), F.lower(F.trim(candidate))
    ratio = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0) \
        .when(F.contains(a, b) | F.contains(b, a), F.greatest(ratio, F.lit(CONTAINMENT_FLOOR))) \
        .otherwise(ratio)
