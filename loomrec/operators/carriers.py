"""Records that carry something: an entry point among their effects, or a property of some scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.functions.scalar import exact_or_glob


def carriers(rows: DataFrame, key: str, body: str, array: str, at: str, wanted: str, scope: str | None = None, scope_at: str | None = None) -> DataFrame:
    """key, first_id, tags (array of struct id, name): the records with an element of ``array`` that carries what is wanted.

    ``at`` is the JSON path, in an element, of an object with value (the id) and name. Digits ask for
    an id, anything else for a name, exact or with wildcards, white space aside. Where ids count by scope, ``scope_at`` is the path
    of an element's scope; an id without a scope is then an error. A record has each id once.
    """
    if wanted.lower().startswith("0x"):
        raise ValueError(f"{wanted} is a record id; a name or a number is wanted")
    if wanted.isdigit() and scope_at is not None and scope is None:
        raise ValueError("ids count by scope: name one")
    element = rows.select(F.col(key), F.explode(F.try_variant_get(F.col(body), f"$.{array}", "array<variant>")).alias("e"))
    told = element.select(key, F.try_variant_get("e", f"{at}.value", "long").alias("id"), F.try_variant_get("e", f"{at}.name", "string").alias("name"), (F.try_variant_get("e", scope_at, "string") if scope_at else F.lit(None).cast("string")).alias("scope"))
    hit = F.col("id") == int(wanted) if wanted.isdigit() else exact_or_glob(F.col("name"), wanted, spaces=False)
    if scope is not None:
        hit = hit & (F.col("scope") == scope)
    each = told.where(F.col("id").isNotNull() & hit).groupBy(key, "id").agg(F.min("name").alias("name"))
    tagged = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("tags"))
    return tagged.select(key, F.col("tags")[0]["id"].alias("first_id"), "tags")
