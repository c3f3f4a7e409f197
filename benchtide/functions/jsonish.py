"""Column functions on JSON values: paths, arrays, objects, fingerprints and rendering."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column | str) -> Column:
    """A VARIANT, or null where the text is no JSON."""
    return F.try_parse_json(text)


def at(value: Column, path: str, kind: str) -> Column:
    """The value at a path such as $.a['b-c'].d, cast to kind; null where it is missing or of another kind."""
    return F.try_variant_get(value, path, kind)


def kind_of(value: Column) -> Column:
    """array, object, string, number, boolean or null."""
    s = F.schema_of_variant(value)
    return (
        F.when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.isNull(), None).otherwise("number")
    )


def number(value: Column, path: str = "$") -> Column:
    """The number at a path. A string that holds digits is no number."""
    x = F.try_variant_get(value, path, "variant")
    return F.when(kind_of(x) == "number", F.try_variant_get(x, "$", "double"))


def as_array(value: Column) -> Column:
    """An array as it is, anything else as an array of one."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))


def mean(xs: Column) -> Column:
    """The mean of an array's non-null numbers; null for none."""
    ys = F.filter(xs, lambda x: x.isNotNull())
    return F.when(F.size(ys) > 0, total(ys) / F.size(ys))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


def scaled(x: Column, by: float, digits: int | None = None) -> Column:
    y = x / F.lit(float(by))
    return y if digits is None else F.round(y, digits)


def guarded_mean(xs: Column, scale: float = 1.0, digits: int = 2) -> Column:
    """Null for a missing or empty array; a null in it counts as 0; the mean is scaled and rounded."""
    ys = F.transform(xs, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    return F.when(F.size(ys) > 0, F.round(total(ys) / F.size(ys) * F.lit(float(scale)), digits))


def mean_if(xs: Column, field: Column, equals: object) -> Column:
    """The mean where the field equals a constant, else null."""
    return F.when(field == F.lit(equals), mean(xs))


def greatest_of(xs: Column, field: Callable[[Column], Column], digits: int) -> Column:
    return F.round(F.array_max(F.transform(xs, field)), digits)


def whole(x: Column) -> Column:
    """The integer part of a number or of a text that holds one."""
    return F.floor(x.try_cast("double"))


def first_valid(*candidates: Column) -> Column:
    """The first that is not null, NaN or the text 'NaN': newest schema variant first."""
    return F.coalesce(*[F.when(~F.isnan(c.try_cast("double")) | c.try_cast("double").isNull(), F.when(c.cast("string") != "NaN", c)) for c in candidates])


def merged(*outputs: Column) -> Column:
    """One array of all outputs: arrays flattened, single values kept."""
    return F.filter(F.flatten(F.array(*[F.coalesce(x, F.array()) for x in outputs])), lambda x: x.isNotNull())


def zipped(**arrays: Column) -> Column:
    """Parallel arrays as an array of records; shorter ones are filled with nulls."""
    return F.arrays_zip(*[a.alias(k) for k, a in arrays.items()])


def js_number(x: Column) -> Column:
    """A number as text, integral ones without a fraction."""
    return F.when(x == F.floor(x), F.format_string("%d", x.cast("bigint"))).otherwise(x.cast("string"))


def js_result(x: Column, defined: Column) -> Column:
    """What a script's result becomes: undefined an empty text, null no value."""
    return F.when(~defined, F.lit("")).otherwise(x)


def fingerprint(parts: Mapping[str, Column] | Sequence[tuple[str, Column]]) -> Column:
    """A JSON object of the parts that are present, keys sorted; of parts with one name the last counts. No part: '{}'."""
    last = dict(parts)
    kinds = [F.struct(F.lit(k).alias("k"), _json(last[k]).alias("v")) for k in sorted(last)]
    present = F.filter(F.array(*kinds), lambda x: x["v"].isNotNull())
    return F.concat(F.lit("{"), F.array_join(F.transform(present, lambda x: F.concat(F.to_json(F.array(x["k"])).substr(F.lit(2), F.length(F.to_json(F.array(x["k"]))) - 2), F.lit(":"), x["v"])), ","), F.lit("}"))


def _json(x: Column) -> Column:
    """One value as JSON text, null for null."""
    text = F.to_json(F.array(x))
    return F.when(x.isNotNull(), text.substr(F.lit(2), F.length(text) - 2))


def value_path(node: str | Column, idx: Column, parents: Column | None = None) -> Column:
    """node=idx, then the paths of the sources."""
    node = F.lit(node) if isinstance(node, str) else node
    own = F.concat(node, F.lit("="), idx.cast("string"))
    return own if parents is None else F.concat_ws(",", own, parents)


def preview(text: Column) -> Column:
    """The first 57 characters and ... where there are more than 60; (no data) for null."""
    return F.when(text.isNull(), "(no data)").when(F.length(text) > 60, F.concat(F.substring(text, 1, 57), F.lit("..."))).otherwise(text)


def sanitised(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_$]", "_")


def comparable(text: Column) -> Column:
    """A value for comparison: trimmed, without enclosing quotes, as a hash where it is long."""
    plain = F.trim(F.regexp_replace(F.trim(text), '^"|"$', ""))
    return F.when(F.length(plain) > 200, F.concat(F.lit("HASH:"), F.md5(plain))).otherwise(plain)


def is_stub(text: Column) -> Column:
    """A placeholder instead of a value."""
    plain = F.trim(F.regexp_replace(F.trim(text), '^"|"$', ""))
    return plain.startswith("Need to collect") | plain.isin("N/A", "TBD", "TODO")


def content_hash(text: Column) -> Column:
    return F.md5(text)
