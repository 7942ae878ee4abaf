"""Scalar expressions on numbers, dates, maps, JSON and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import vocabulary as V
from brindle.functions.text import col, sha256


def normalize_score(c: Column | str, low: Column, high: Column) -> Column:
    return F.when(high == low, 0.0).otherwise((col(c) - low) / (high - low))


def safe_divide(a: Column | str, b: Column | str, default: float = 0.0) -> Column:
    return F.when(col(b) == 0, F.lit(default)).otherwise(F.try_divide(col(a), col(b)))


def _two_places(c: Column, unit: str) -> Column:
    """Two decimals of the double's exact value, as C formats it: exact halves to the even digit.

    ``bround`` takes the shortest decimal of a double (1.225) for its value (1.22500000000000008882).
    """
    size = F.abs(c)
    n = F.floor(size * 100).cast("double")
    head = size.cast("float").cast("double")
    over = (200 * head - (2 * n + 1)) + 200 * (size - head)  # 200 x size against the half: both products and the first difference are exact
    cents = n + F.when(over > 0, 1.0).when(over == 0, n % 2).otherwise(0.0)
    return F.format_string(f"%.2f{unit}", F.when(size < 2.0**44, F.signum(c) * cents / 100).otherwise(F.bround(c, 2)))


def format_bytes(c: Column | str) -> Column:
    c = col(c).cast("double")
    out = _two_places(c / 1024.0**5, " PB")
    for i, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        out = F.when(c < 1024.0 ** (i + 1), _two_places(c / 1024.0**i, f" {unit}")).otherwise(out)
    return out


def format_duration(seconds: Column | str) -> Column:
    """Milliseconds, seconds, minutes or hours."""
    s = col(seconds).cast("double")
    ms = F.format_string("%dms", F.bround(s * 1000, 0).cast("bigint"))
    return F.when(s < 1, ms).when(s < 60, _two_places(s, "s")).when(s < 3600, _two_places(s / 60, "m")).otherwise(_two_places(s / 3600, "h"))


def parse_date(c: Column | str) -> Column:
    """The first of six formats that fits, month before day; else null."""
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(f)) for f in V.DATE_FORMATS])


def age(birth: Column | str, reference: Column | str) -> Column:
    b, r = col(birth), col(reference)
    before = (F.month(r) < F.month(b)) | ((F.month(r) == F.month(b)) & (F.dayofmonth(r) < F.dayofmonth(b)))
    return F.year(r) - F.year(b) - F.when(before, 1).otherwise(0)


def merge_maps(a: Column | str, b: Column | str) -> Column:
    """Both maps' keys; the right one wins."""
    a, b = col(a), col(b)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def deep_get(json: Column | str, path: str, default: str | None = None) -> Column:
    """The value of a JSON text at a dotted path."""
    return F.coalesce(F.get_json_object(col(json), "$." + path), F.lit(default))


def deep_set(json: Column | str, path: str, value: Column) -> Column:
    """A JSON object with a string value set at a dotted path; all other keys stay, at every level.

    Null or broken JSON counts as an empty object, and so does a value on the way that is no object.
    """
    kind = "map<string,variant>"
    written = F.to_json(F.named_struct(F.lit("v"), value))
    written = F.substring(written, F.lit(6), F.length(written) - 6)

    def put(object_text: Column, keys: list[str]) -> Column:
        key, *rest = keys
        top = F.coalesce(F.from_json(object_text, kind), F.from_json(F.lit("{}"), kind))
        if rest:
            below = F.try_element_at(top, F.lit(key))
            below = F.when(F.startswith(F.schema_of_variant(below), F.lit("OBJECT")), F.to_json(below)).otherwise(F.lit("{}"))
        inner = put(below, rest) if rest else written
        return F.to_json(F.map_concat(F.map_filter(top, lambda k, _: k != key), F.create_map(F.lit(key), F.parse_json(inner))))

    return put(col(json), path.split("."))


def generate_id() -> Column:
    """A random id of 16 hexadecimal digits; a new one each time that a row is computed."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)


def nesting(json: Column | str) -> Column:
    """How deep the objects of a JSON text are nested: 1 for a flat one, 0 without any. Braces inside strings don't count."""
    bare = F.regexp_replace(col(json), r'"(?:[^"\\]|\\.)*+"|[^"{}]++', "")
    depth = F.aggregate(
        F.split(bare, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, c: F.struct((a["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c == "{", 1).otherwise(0)).alias("most")),
        lambda a: a["most"],
    )
    return F.coalesce(depth, F.lit(0))


def deepest(rows: DataFrame, *json: str) -> int:
    """The greatest ``nesting`` in the JSON columns: what ``flatten_json`` and ``merge_json`` need to take all of it apart."""
    return rows.agg(F.max(F.greatest(F.lit(0), *map(nesting, json)))).first()[0] or 0


_OBJECT = "map<string,variant>"


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def flatten_json(json: Column | str, depth: int = 4) -> Column:
    """map<string,string> from dotted keys to values of a JSON object, nested up to ``depth`` levels (see ``deepest``).

    Arrays and what lies deeper stay JSON texts; empty objects have no keys; of equal dotted keys the last one counts.
    """

    def deeper(e: Column) -> Column:
        inside = F.transform(F.map_entries(e["value"].cast(_OBJECT)), lambda i: F.struct(F.concat_ws(".", e["key"], i["key"]).alias("key"), i["value"].alias("value")))
        return F.when(_is_object(e["value"]), inside).otherwise(F.array(e))

    pairs = F.map_entries(F.from_json(col(json), _OBJECT))
    for _ in range(depth - 1):
        pairs = F.flatten(F.transform(pairs, deeper))
    empty = F.schema_of_variant
    once = F.transform(F.array(pairs), lambda p: F.filter(p, lambda e, i: (empty(e["value"]) != "OBJECT<>") & ~F.exists(F.slice(p, i + 2, F.size(p)), lambda later: later["key"] == e["key"])))
    return F.map_from_entries(F.transform(F.element_at(once, 1), lambda e: F.struct(e["key"], e["value"].cast("string"))))


def merge_json(a: Column | str, b: Column | str, depth: int = 4) -> Column:
    """Two JSON objects as one, as text: objects under equal keys are merged down to ``depth`` levels (see ``deepest``), else the right value wins.

    What is null or no object counts as an empty one.
    """

    def merged(x: Column, y: Column, left: int) -> Column:
        def pick(_, v: Column, w: Column) -> Column:
            plain = F.coalesce(w, v)
            if left <= 1:
                return plain
            both = _is_object(v) & _is_object(w)
            return F.when(both, F.to_variant_object(merged(v.cast(_OBJECT), w.cast(_OBJECT), left - 1))).otherwise(plain)

        return F.map_zip_with(x, y, pick)

    top = lambda c: F.coalesce(F.from_json(col(c), _OBJECT), F.from_json(F.lit("{}"), _OBJECT))
    return F.to_json(merged(top(a), top(b), max(depth, 1)))


def is_json(c: Column | str) -> Column:
    """Whether a text is one JSON value with nothing after it."""
    inside = F.concat(F.lit("["), col(c), F.lit("]"))
    return F.try_parse_json(inside).isNotNull() & (F.coalesce(F.json_array_length(inside), F.lit(0)) == 1)


def batches(c: Column | str, size: int) -> Column:
    """An array cut into arrays of ``size`` elements."""
    c = col(c)
    starts = F.when(F.size(c) > 0, F.sequence(F.lit(1), F.size(c), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(c, i, size))


def cache_key(model: str, text: Column | str) -> Column:
    return F.concat(F.lit(f"embedding:{model}:"), sha256(text))


def has_access(study: Column | str, studies: Column | str, permissions: Column | str) -> Column:
    """Whether a user may see a study: it is on the list, or the user holds the permission ``admin``."""
    return F.coalesce(F.array_contains(col(studies), col(study)), F.lit(False)) | F.coalesce(F.array_contains(col(permissions), F.lit("admin")), F.lit(False))
