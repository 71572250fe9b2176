"""Differences of nested bodies: arrays are exploded to elements and paired by what identifies them.

Bodies are variants. Values are told apart by their JSON text, so 1, "1" and true differ and the
order of an object's fields does not count; a JSON null is like a field that is not there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.operators.lookup import leaves

#: What identifies an element, in order of precedence. Each rule is a list of keys, each
#: key a list of alternatives, each alternative a path; every key of a rule must be there.
IDENTITIES: list[list[list[list[str]]]] = [
    [[["Function Type"]], [["Property"]]],
    [[["Leveled List Entry", "Reference"], ["Leveled List Entry", "Item"]], [["Leveled List Entry", "Minimum Level"], ["Leveled List Entry", "Level"]]],
    [[["Effect", "Base Effect"]]],
    [[["Component"]]],
    [[["Item Type"]]],
    [[["Objective", "Objective Index"]]],
    [[["Stage", "INDX", "Stage Index"]]],
    [[["Attack", "Attack Event"]]],
    [[["Faction"]]],
    [[["Perk"]]],
    [[["Mod"]]],
    [[["Keyword"]], [["Sound"]]],
    [[["Alias ID"]]],
]


def kind_of(value: Column) -> Column:
    """The first letter of a variant's type: O is an object, A an array, V a JSON null, any other a scalar."""
    return F.substring(F.schema_of_variant(value), 1, 1)


def members(value: Column) -> Column:
    """An object's fields as a map of variants; an empty map if it is no object."""
    return F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is named."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, then)


def step_into(value: Column, path: Column) -> Column:
    """The variant at a path (array of names), null if it is not there."""
    return _known(F.aggregate(path, value, lambda v, name: F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), name)))


def _known(value: Column) -> Column:
    """A variant, null if it is a JSON null."""
    return let(value, lambda v: F.when(~F.is_variant_null(v), v))


def _keys_of(value: Column, keys: Column) -> Column:
    """What an element is matched by at each of the keys, an array of texts; its fields are taken apart once."""
    rest = lambda fields, way: step_into(F.try_element_at(fields, F.get(way, F.lit(0))), F.slice(way, 2, F.size(way)))
    first = lambda fields, ways: F.get(F.filter(F.transform(ways, lambda w: rest(fields, w)), lambda x: x.isNotNull()), F.lit(0))
    return let(F.try_variant_get(value, "$", "map<string,variant>"), lambda fields: F.transform(keys, lambda ways: F.coalesce(matching_text(first(fields, ways)), F.lit("null"))))


def is_scalar(value: Column) -> Column:
    return ~F.coalesce(kind_of(value), F.lit("V")).isin("O", "A")


def has_field(value: Column, name: str) -> Column:
    """Whether a variant is an object with a field of that name, be it a JSON null."""
    return F.try_variant_get(value, f"$['{name}']", "variant").isNotNull()


def is_reference(value: Column) -> Column:
    """A text like 0x..., or an object with a formid."""
    return F.coalesce(F.try_variant_get(value, "$", "string").startswith("0x"), F.lit(False)) | has_field(value, "formid")


def matching_text(value: Column) -> Column:
    """What a key is matched by: a reference is its id, an enum its number, anything else itself."""
    own = lambda v: F.coalesce(F.try_variant_get(v, "$.formid", "variant"), F.try_variant_get(v, "$.value", "variant"), v)
    return let(value, lambda v: F.to_json(own(v)))


def _paths(items: list) -> Column:
    return F.array(*[F.array(*[F.array(*[F.lit(name) for name in way]) for way in ways]) for ways in items])


def _at(value: Column, path: list[str]) -> Column:
    """The variant at a path that is known beforehand, null if it is not there."""
    if any("'" in name for name in path):
        return step_into(value, F.array(*[F.lit(name) for name in path]))
    found = F.try_variant_get(value, "$" + "".join(f"['{name}']" for name in path), "variant")
    return F.when(~F.is_variant_null(found), found)


def _rule_of(sample: Column, rules: list[list[list[list[str]]]]) -> Column:
    """The number of the first rule whose keys are all there; null if none fits."""
    return F.coalesce(F.lit(None).cast("int"), *[F.when(reduce(and_, [reduce(or_, [_at(sample, way).isNotNull() for way in ways]) for ways in rule]), F.lit(i)) for i, rule in enumerate(rules)])


def _rule_keys(value: Column, number: Column, rules: list[list[list[list[str]]]]) -> Column:
    """What an element is matched by under the rule of that number, as ``_keys_of`` finds it."""
    each = [F.array(*[F.coalesce(matching_text(F.coalesce(*[_at(value, way) for way in ways])), F.lit("null")) for ways in rule]) for rule in rules]
    return reduce(lambda case, i: case.when(number == i, each[i]), range(1, len(each)), F.when(number == 0, each[0]))


def identity(sample: Column, rules: list[list[list[list[str]]]]) -> Column:
    """The keys (each an array of alternative paths) that identify elements like ``sample``; null if nothing does.

    The first rule that fits; else the first index field; else name where name, type and value are
    there; else all references. The last three look inside where a lone field holds an object.
    """

    def own_keys(names: Column, body: Column, inside: Column) -> Column:
        none = F.array().cast("array<string>")
        indexes = F.slice(F.filter(names, lambda n: (n == "Index") | n.endswith(" Index")), 1, 1)
        typed = F.when(F.size(F.array_intersect(names, F.array(F.lit("name"), F.lit("type"), F.lit("value")))) == 3, F.array(F.lit("name"))).otherwise(none)
        references = F.filter(names, lambda n: is_reference(F.try_element_at(body, n)))
        found = F.get(F.filter(F.array(indexes, typed, references), lambda k: F.size(k) > 0), F.lit(0))
        return F.transform(found, lambda n: F.array(F.concat(inside, F.array(n))))

    def inside_of(outer: Column) -> Column:
        wraps = lambda n: (kind_of(F.try_element_at(outer, n)) == "O") & ~is_reference(F.try_element_at(outer, n))
        return F.filter(F.when(F.size(outer) == 1, F.map_keys(outer)).otherwise(F.array().cast("array<string>")), wraps)

    fallback = let(inside_of(members(sample)), lambda inside: let(members(step_into(sample, inside)), lambda body: own_keys(F.array_sort(F.map_keys(body)), body, inside)))
    return F.coalesce(F.get(F.array(*[_paths(rule) for rule in rules]), _rule_of(sample, rules)), fallback) if rules else fallback


def scalar_paths(sample: Column) -> Column:
    """Paths to an object's scalars, two levels deep, by name; each as a key with one alternative."""

    def below(outer: Column, name: Column) -> Column:
        deep = lambda inner: F.transform(F.filter(F.array_sort(F.map_keys(inner)), lambda k: is_scalar(F.try_element_at(inner, k))), lambda k: F.array(F.array(name, k)))
        return F.when(is_scalar(F.try_element_at(outer, name)), F.array(F.array(F.array(name)))).otherwise(let(members(F.try_element_at(outer, name)), deep))

    return let(members(sample), lambda outer: F.flatten(F.transform(F.array_sort(F.map_keys(outer)), lambda name: below(outer, name))))


def aligned(a: list[str], b: list[str], most_cells: int | None) -> tuple[list[int], list[int]]:
    """Places of ``a`` and of ``b`` outside a longest common subsequence; of equal choices the element of ``a`` goes.

    A common start and end are left out first. Where what remains has more than ``most_cells`` pairs
    the order does not count: what one side has more of goes, first copies first.
    """
    low, high, most = 0, 0, min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    while high < most - low and a[-1 - high] == b[-1 - high]:
        high += 1
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    if most_cells is not None and len(x) * len(y) > most_cells:
        return _surplus(x, y, low), _surplus(y, x, low)
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in reversed(range(len(x))):
        for j in reversed(range(len(y))):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    gone, new, i, j = [], [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            gone.append(low + i)
            i += 1
        else:
            new.append(low + j)
            j += 1
    return gone + list(range(low + i, low + len(x))), new + list(range(low + j, low + len(y)))


def _surplus(side: list[str], other: list[str], low: int) -> list[int]:
    left: dict[str, int] = {}
    for v in side:
        left[v] = left.get(v, 0) + 1
    for v in other:
        if v in left:
            left[v] -= 1
    out = []
    for i, v in enumerate(side):
        if left[v] > 0:
            left[v] -= 1
            out.append(low + i)
    return out


def _judged(old: Column, new: Column, rules: list) -> Column:
    """How two arrays are compared: struct strategy, key_fields, old and new (texts), ids_old and ids_new (of keyed ones); null if they do not differ.

    Every step is a value of the record's own row, worked out once; further keys only where the first ones repeat.
    """
    texts = lambda side: F.transform(side, lambda v: F.to_json(v))
    # A JSON text has no bare line end, so joined texts are equal where all of them are.
    unique = lambda each: F.size(F.array_distinct(F.transform(each, lambda k: F.array_join(k, "\n")))) == F.size(each)
    none = F.lit(None).cast("array<array<string>>")

    def longest_start(each: Column) -> Column:
        """How many first keys two elements share at most: in order of all keys, neighbours share most."""
        start = lambda a, b: let(F.array_position(F.zip_with(a, b, lambda x, y: x != y), True), lambda p: F.when(p == 0, F.size(a)).otherwise(p - 1).cast("int"))
        return let(F.sort_array(each), lambda s: F.coalesce(F.array_max(F.transform(s, lambda k, i: F.when(i > 0, start(k, F.get(s, i - 1))))), F.lit(0)))

    def told(t: Column, strategy: Column | str, fields: Column | None = None, ids_old: Column = none, ids_new: Column = none) -> Column:
        named = F.lit(strategy) if isinstance(strategy, str) else strategy
        return F.struct(named.alias("strategy"), (F.lit(None).cast("string") if fields is None else fields).alias("key_fields"), t["old"].alias("old"), t["new"].alias("new"), ids_old.alias("ids_old"), ids_new.alias("ids_new"))

    def keyed(a: Column, t: Column, sample: Column, spec: Column) -> Column:
        present = lambda ways: F.coalesce(F.get(F.filter(ways, lambda w: step_into(sample, w).isNotNull()), F.lit(0)), F.get(ways, F.lit(0)))
        fields = lambda keys: F.array_join(F.transform(keys, lambda ways: F.array_join(present(ways), "/")), ",")

        def first_keys(number: Column) -> Column:
            one = lambda v: F.when(number.isNull(), _keys_of(v, spec)).otherwise(_rule_keys(v, number, rules)) if rules else _keys_of(v, spec)
            return F.struct(*[F.transform(a[side], one).alias(side) for side in ("old", "new")])

        def widened(own: Column, more: Column) -> Column:
            keys = F.concat(spec, more)

            def cut(full: Column) -> Column:
                first = lambda side, level: F.transform(full[side], lambda k: F.slice(k, 1, level))
                level = F.greatest(longest_start(full["old"]) + 1, longest_start(full["new"]) + 1, F.size(spec))
                return let(level, lambda n: F.when(n > F.size(keys), told(t, "unkeyed")).otherwise(told(t, "keyed", fields(F.slice(keys, 1, n)), first("old", n), first("new", n))))

            return let(F.struct(*[F.zip_with(own[side], F.transform(a[side], lambda v: _keys_of(v, more)), lambda x, y: F.concat(x, y)).alias(side) for side in ("old", "new")]), cut)

        def narrow(own: Column) -> Column:
            wide = let(F.array_except(scalar_paths(sample), spec), lambda more: widened(own, more))
            return F.when(unique(own["old"]) & unique(own["new"]), told(t, "keyed", fields(spec), own["old"], own["new"])).otherwise(wide)

        return let(_rule_of(sample, rules), lambda number: let(first_keys(number), narrow))

    def judge(a: Column, t: Column) -> Column:
        # The first letter of a JSON text tells objects and arrays from anything else.
        is_kind = lambda x, *kinds: F.coalesce(F.substring(x, 1, 1), F.lit("n")).isin(*kinds)
        both = lambda test: F.forall(t["old"], test) & F.forall(t["new"], test)
        alike = F.size(t["old"]) == F.size(t["new"])
        in_place = F.when(alike, "positional").otherwise("unkeyed")
        by_keys = lambda sample: let(identity(sample, rules), lambda spec: F.when(spec.isNotNull(), keyed(a, t, sample, spec)).otherwise(told(t, in_place)))
        return (
            F.when(both(lambda x: ~is_kind(x, "{", "[")), told(t, "set"))
            .when(both(lambda x: is_kind(x, "[")), told(t, in_place))
            .when(both(lambda x: is_kind(x, "{")), let(F.coalesce(F.get(a["old"], F.lit(0)), F.get(a["new"], F.lit(0))), by_keys))
            .otherwise(told(t, "unkeyed"))
        )

    def differ(a: Column) -> Column:
        return let(F.struct(texts(a["old"]).alias("old"), texts(a["new"]).alias("new")), lambda t: F.when(t["old"].isNotNull() & t["new"].isNotNull() & ~t["old"].eqNullSafe(t["new"]), judge(a, t)))

    return let(F.struct(old.alias("old"), new.alias("new")), differ)


def _paired(j: Column, lined: Column) -> Column:
    """The element pairs of arrays as ``_judged`` told them: array of struct id, index_from, index_to, from, to."""

    def row(told: Column, i: Column, k: Column, was: Column, now: Column) -> Column:
        return F.struct(told.alias("id"), i.cast("int").alias("index_from"), k.cast("int").alias("index_to"), was.alias("from"), now.alias("to"))

    def sided(side: str, number: int) -> Column:
        own = lambda t, i: F.coalesce(F.get(j[f"ids_{side}"], i), F.array(t))
        return F.transform(j[side], lambda t, i: F.struct(own(t, i).alias("id"), F.lit(number).alias("side"), i.alias("at"), t.alias("text")))

    def of_run(run: Column) -> Column:
        """Of one id's elements, the old ones first, the k-th old one and the k-th new one are a pair."""

        def each(n: Column) -> Column:
            pair = lambda k: F.struct(F.get(run, F.when(k < n, k)).alias("a"), F.get(run, n + k).alias("b"))
            told = lambda p: row(F.get(run, F.lit(0))["id"], p["a"]["at"], p["b"]["at"], p["a"]["text"], p["b"]["text"])
            return F.transform(F.sequence(F.lit(0), F.greatest(n, F.size(run) - n) - 1), lambda k: let(pair(k), told))

        return let(F.size(F.filter(run, lambda e: e["side"] == 0)), each)

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda e, i: F.when((i == 0) | ~e["id"].eqNullSafe(F.get(s, i - 1)["id"]), i)), lambda i: i.isNotNull())
        run = lambda b, at: F.slice(s, b + 1, F.coalesce(F.get(at["starts"], at["i"] + 1), F.size(s)) - b)
        return let(starts, lambda st: F.flatten(F.transform(st, lambda b, i: let(run(b, {"starts": st, "i": i}), of_run))))

    by_place = F.transform(j["old"], lambda t, i: row(F.array(i.cast("string")), i, i, t, F.get(j["new"], i)))
    in_line = F.transform(lined, lambda m: let(F.struct(F.get(j["old"], m["i"]).alias("a"), F.get(j["new"], m["j"]).alias("b")), lambda p: row(F.array(F.coalesce(p["a"], p["b"])), m["i"], m["j"], p["a"], p["b"])))
    by_id = let(F.sort_array(F.concat(sided("old", 0), sided("new", 1))), runs)
    return F.when(j["strategy"] == "positional", by_place).when(j["strategy"] == "unkeyed", in_line).otherwise(by_id)


def array_pairs(pairs: DataFrame, key: str, path: str, rules: list = IDENTITIES, most_cells: int | None = 250_000) -> DataFrame:
    """key, strategy, key_fields, id, status (removed, added, changed, same), index_from, index_to, from, to of every element pair.

    ``pairs`` has a unique key and the bodies old and new; ``path`` names an array of both. Records whose
    arrays are equal, or missing on a side, have no rows. Scalars are paired as a multiset; arrays of arrays of
    one length, and objects of one length that nothing identifies, by place; objects by their keys, which are
    widened by further scalars until no two elements of a side share them. Anything else is aligned
    in order (``most_cells`` as in ``aligned``, None for any size). A record's arrays stand in its own row and are
    compared there, so nothing is shuffled or sorted across rows.
    """
    sides = [F.try_variant_get(F.col(s), f"$['{path}']", "array<variant>") for s in ("old", "new")]
    judged = pairs.select(F.col(key), _judged(*sides, rules).alias("j"))

    @F.pandas_udf("array<struct<i:int,j:int>>")
    def in_order(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([_matched(list(x), list(y), most_cells) for x, y in zip(a, b, strict=True)])

    unkeyed = lambda side: F.when(F.col("j.strategy") == "unkeyed", F.col(f"j.{side}")).otherwise(F.array().cast("array<string>"))
    lined = judged.withColumn("m", in_order(unkeyed("old"), unkeyed("new")))
    met = lined.select(key, F.col("j.strategy").alias("strategy"), F.col("j.key_fields").alias("key_fields"), F.inline(_paired(F.col("j"), F.col("m"))))
    status = F.when(F.col("index_to").isNull(), "removed").when(F.col("index_from").isNull(), "added").when((F.col("from") != F.col("to")) & (F.col("strategy") != "unkeyed"), "changed").otherwise("same")
    return met.withColumn("status", status)


def _matched(a: list[str], b: list[str], most_cells: int | None) -> list[dict]:
    """Pairs of places: matched ones, then those of one side alone."""
    gone, new = aligned(a, b, most_cells)
    out = [{"i": i, "j": None} for i in gone] + [{"i": None, "j": j} for j in new]
    lost, fresh = set(gone), set(new)
    kept = zip((i for i in range(len(a)) if i not in lost), (j for j in range(len(b)) if j not in fresh), strict=True)
    return out + [{"i": i, "j": j} for i, j in kept]


def envelopes(found: DataFrame, key: str) -> DataFrame:
    """key, strategy, key_fields, count_from, count_to, n_removed, n_added, n_changed, unchanged_count of arrays that differ, from ``array_pairs``."""
    n = lambda s: F.count_if(F.col("status") == s)
    sums = found.groupBy(key, "strategy", "key_fields").agg(F.count("index_from").alias("count_from"), F.count("index_to").alias("count_to"), n("removed").alias("n_removed"), n("added").alias("n_added"), n("changed").alias("n_changed"), n("same").alias("unchanged_count"))
    return sums.where("n_removed + n_added + n_changed > 0")


def change_entries(pairs: DataFrame, key: str) -> DataFrame:
    """key, path, kind, from, to: each leaf of the bodies old and new that differs, with JSON texts of its two sides.

    Arrays, enums, flags, references and raw bytes are leaves. Kinds, in this order: raw, array,
    enum, flags, formid, string, scalar. A kind by shape needs every side that is there to have it, raw
    and array one side.
    """

    def whole(value: Column) -> Column:
        named = reduce(or_, [has_field(value, name) for name in ("_raw", "formid", "flags", "_unresolved")])
        return (kind_of(value) == "A") | named | (has_field(value, "value") & has_field(value, "name"))

    # Both sides are one array, so that a record's bodies are worked out, compared and taken apart once.
    bodies = let(F.struct("old", "new"), lambda b: F.when(~F.to_json(b["old"]).eqNullSafe(F.to_json(b["new"])), F.transform(F.array(b["old"], b["new"]), lambda v, i: F.struct(i.alias("side"), v.alias("body")))))
    each = pairs.select(key, F.inline(bodies)).select(F.struct(F.col(key).alias("key"), "side").alias("_of"), "body")
    found = leaves(each, "_of", "body", whole, lambda v: ~F.is_variant_null(v))
    sides = [found.where(F.col("_of.side") == i).select(F.col("_of.key").alias(key), "path", F.col("leaf").alias(side)) for i, side in enumerate(("old", "new"))]
    rows = sides[0].join(sides[1], [key, "path"], "full_outer").where("not (to_json(old) <=> to_json(new))")
    has = lambda side, name: has_field(F.col(side), name)
    either = lambda test: F.coalesce(test("old"), F.lit(False)) | F.coalesce(test("new"), F.lit(False))
    every = lambda test: F.coalesce(F.when(F.col("old").isNull(), True).otherwise(test("old")), F.lit(False)) & F.coalesce(F.when(F.col("new").isNull(), True).otherwise(test("new")), F.lit(False))
    text = lambda side: F.schema_of_variant(side) == "STRING"
    kind = (
        F.when(either(lambda s: has(s, "_raw")), "raw")
        .when(either(lambda s: kind_of(F.col(s)) == "A"), "array")
        .when(every(lambda s: has(s, "value") & has(s, "name") & ~has(s, "flags")), "enum")
        .when(every(lambda s: has(s, "flags")), "flags")
        .when(every(lambda s: is_reference(F.col(s))), "formid")
        .when(every(lambda s: has(s, "_unresolved")) | either(text), "string")
        .otherwise("scalar")
    )
    return rows.select(key, "path", kind.alias("kind"), F.to_json("old").alias("from"), F.to_json("new").alias("to"))


def references_out(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, path, form_id: every reference text in a body with where it stands, once; what is raw or unresolved is left out."""
    skipped = lambda v: has_field(v, "_raw") | has_field(v, "_unresolved")
    own = F.try_variant_get("leaf", "$.formid", "variant")
    found = leaves(rows, key, body, lambda v: skipped(v) | has_field(v, "formid"), lambda v: ~skipped(v) & is_reference(v))
    text = F.try_variant_get(F.coalesce(own, F.col("leaf")), "$", "string")
    return found.select(key, "path", text.alias("form_id")).distinct()
