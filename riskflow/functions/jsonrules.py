"""JSON-schema rules compiled once on the driver into Spark column expressions.

The schema is data; this module turns it into one ``coalesce`` of checks so the
first failure wins, in the fixed order: decode -> object -> required (all
missing names, schema order) -> type/length per property (schema order) ->
enum -> minimum.  Everything is JVM-side (variant functions, codegen).

Missing and JSON ``null`` differ: ``variant_get(v, '$.k')`` is SQL NULL when
the key is absent and a variant null (``is_variant_null``) when it is ``null``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow.contract import MSG_INVALID_JSON, MSG_MISSING_FIELDS, MSG_NOT_OBJECT

def _lit(text: str) -> str:
    """Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parse_strict_sql(raw: str) -> tuple[str, str]:
    """SQL text of (variant, error) for a JSON text that must hold exactly one object.

    ``try_parse_json`` ignores trailing text, so the text is parsed inside two
    wrappers (an array and an object member).  Each wrapper alone can be
    fooled by a premature close (']' resp. '}'), never both at once.  The
    value is taken from the member wrapper, so a row costs two parses; once
    the text is a single valid JSON value it is an object iff it opens with '{'.
    Bytes that are not UTF-8 are no JSON text.
    """
    arr = f"try_parse_json(concat('[', {raw}, ']'))"
    mem = f"try_parse_json(concat('{{\"r\":', {raw}, '}}'))"
    v = f"variant_get({mem}, '$.r', 'variant')"
    valid = f"({arr} IS NOT NULL AND {mem} IS NOT NULL AND variant_get({arr}, '$[1]', 'variant') IS NULL)"
    err = (f"CASE WHEN {raw} IS NULL OR NOT is_valid_utf8({raw}) OR NOT {valid} THEN {_lit(MSG_INVALID_JSON)} "
           f"WHEN NOT ({raw} RLIKE '^[ \\\\t\\\\r\\\\n]*[{{]') THEN {_lit(MSG_NOT_OBJECT)} END")
    return v, err


def parse_strict(raw_col: str) -> tuple[Column, Column]:
    """Column form of :func:`parse_strict_sql` for a named column."""
    v, err = parse_strict_sql(f"`{raw_col}`")
    return F.expr(v), F.expr(err)


def py_list_text(names: Column) -> Column:
    """Render an array<string> the way Python prints a list of str: ['a', 'b']."""
    quoted = F.transform(names, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def py_float_text(x: float) -> str:
    return repr(float(x))


def _target(spec: dict) -> str:
    t = spec.get("type")
    return {"number": "double", "integer": "bigint", "boolean": "boolean"}.get(t, "string")


def field_facts(v: str, schema: dict) -> list[str]:
    """SQL text per declared member, computed once: type name (_k_), text (_s_), typed value (_t_)."""
    out: list[str] = []
    for name, spec in schema.get("properties", {}).items():
        if not isinstance(spec, dict):
            continue
        out.append(f"schema_of_variant(variant_get({v}, '$.{name}', 'variant')) AS `_k_{name}`")
        out.append(f"try_variant_get({v}, '$.{name}', 'string') AS `_s_{name}`")
        out.append(f"try_variant_get({v}, '$.{name}', '{_target(spec)}') AS `_t_{name}`")
    for name in schema.get("required", []):
        if name not in schema.get("properties", {}):
            out.append(f"schema_of_variant(variant_get({v}, '$.{name}', 'variant')) AS `_k_{name}`")
    return out


def _numeric_sql(k: str) -> str:
    return f"({k} IN ('BIGINT', 'DOUBLE') OR startswith({k}, 'DECIMAL'))"


def _enum_sql(name: str, values: list) -> str:
    """SQL text: the member equals one of ``values`` (text, numbers, booleans or null)."""
    k, s = f"`_k_{name}`", f"`_s_{name}`"
    tests = []
    text = [_lit(a) for a in values if isinstance(a, str)]
    flags = [_lit(str(a).lower()) for a in values if isinstance(a, bool)]
    numbers = [f"CAST({float(a)!r} AS DOUBLE)" for a in values if isinstance(a, (int, float)) and not isinstance(a, bool)]
    if text:
        tests.append(f"{k} = 'STRING' AND {s} IN ({', '.join(text)})")
    if flags:
        tests.append(f"{k} = 'BOOLEAN' AND {s} IN ({', '.join(flags)})")
    if numbers:
        tests.append(f"{_numeric_sql(k)} AND try_cast({s} AS DOUBLE) IN ({', '.join(numbers)})")
    if None in values:
        tests.append(f"{k} = 'VOID'")
    return " OR ".join(f"({t})" for t in tests) or "false"


def schema_error(schema: dict) -> str:
    """SQL text: first failing rule over the :func:`field_facts` columns (NULL when all pass)."""
    required = list(schema.get("required", []))
    props = schema.get("properties", {})
    checks: list[str] = []

    def k(name: str) -> str:
        return f"`_k_{name}`"

    if required:
        names = ", ".join(f"CASE WHEN {k(n)} IS NULL THEN '{n}' END" for n in required)
        missing = f"array_compact(array({names}))"
        checks.append(
            f"CASE WHEN size({missing}) > 0 THEN concat({_lit(MSG_MISSING_FIELDS)}, '[', "
            f"array_join(transform({missing}, x -> concat('\\'', x, '\\'')), ', '), ']') END"
        )
    for name, spec in props.items():
        if not isinstance(spec, dict):
            continue
        present = f"{k(name)} IS NOT NULL"
        t = spec.get("type")
        if t == "string":
            checks.append(f"CASE WHEN {present} AND {k(name)} <> 'STRING' THEN {_lit(f'Field {name!r} must be a string.')} END")
            ml = spec.get("minLength")
            if isinstance(ml, int) and not isinstance(ml, bool):
                checks.append(f"CASE WHEN {present} AND length(`_s_{name}`) < {ml} "
                              f"THEN {_lit(f'Field {name!r} must have length >= {ml}.')} END")
        elif t == "number":
            checks.append(f"CASE WHEN {present} AND NOT {_numeric_sql(k(name))} THEN {_lit(f'Field {name!r} must be numeric.')} END")
        elif t == "integer":
            checks.append(f"CASE WHEN {present} AND NOT ({k(name)} = 'BIGINT' OR {k(name)} RLIKE '^DECIMAL\\\\(\\\\d+,0\\\\)$') "
                          f"THEN {_lit(f'Field {name!r} must be an integer.')} END")
        elif t == "boolean":
            checks.append(f"CASE WHEN {present} AND {k(name)} <> 'BOOLEAN' THEN {_lit(f'Field {name!r} must be a boolean.')} END")
    for name, spec in props.items():
        if isinstance(spec, dict) and "enum" in spec:
            checks.append(f"CASE WHEN {k(name)} IS NOT NULL AND NOT coalesce({_enum_sql(name, spec['enum'])}, false) "
                          f"THEN concat({_lit(f'Invalid value for {name!r}: ')}, coalesce(`_s_{name}`, 'None')) END")
    for name, spec in props.items():
        if isinstance(spec, dict) and "minimum" in spec:
            lo = float(spec["minimum"])
            checks.append(
                f"CASE WHEN {k(name)} IS NOT NULL AND NOT {_numeric_sql(k(name))} THEN {_lit(f'Field {name!r} must be numeric.')} "
                f"WHEN {k(name)} IS NOT NULL AND CAST(`_t_{name}` AS DOUBLE) < CAST({lo!r} AS DOUBLE) "
                f"THEN {_lit(f'Field {name!r} must be >= {py_float_text(lo)}.')} END"
            )
    return "coalesce(" + ", ".join(checks) + ")" if checks else "CAST(NULL AS STRING)"
