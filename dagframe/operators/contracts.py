"""Contracts: schemas of JSON payloads, checked to the first error with its code and path; envelopes around values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a type name admits among the types of Spark's JSON schemas.
_KINDS = {"string": ("STRING",), "boolean": ("BOOLEAN",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "null": ("VOID",), "array": ("ARRAY",), "object": ("OBJECT",)}
MEDIA = {"json": "application/json", "markdown": "text/markdown", "text": "text/plain", "table": "application/json", "artifact_ref": "application/json"}


class MalformedSchema(ValueError):
    pass


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _is(v: Column, name: str) -> Column:
    if name == "integer":
        whole = F.when(_kind(v) == "DECIMAL", F.try_variant_get(v, "$", "string").rlike(r"^-?[0-9]+([.]0*)?$")).when(_kind(v) == "DOUBLE", F.try_variant_get(v, "$", "double") % 1 == 0)
        return (_kind(v) == "BIGINT") | F.coalesce(whole, F.lit(False))
    if name not in _KINDS:
        raise MalformedSchema(f"type {name}")
    return _kind(v).isin(*_KINDS[name])


def _error(code: str, path: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"))


def _step(name: str) -> str:
    """A property in a variant's path, whatever signs its name has."""
    if '"' in name and "'" in name:
        raise MalformedSchema(f"property {name}")
    return f"['{name}']" if '"' in name else f'["{name}"]'


def checks(payload: Column, schema: dict, path: str = "$", place: str = "$") -> list[Column]:
    """Errors in order, null where none: enum, type, lengths, bounds, required, unexpected, properties by name, items.

    `path` is how an error names the value, `place` where it stands in the payload."""
    at = F.try_variant_get(payload, place, "variant")
    text, number = F.try_variant_get(payload, place, "string"), F.try_variant_get(payload, place, "double")
    there = at.isNotNull()
    out = []
    if "enum" in schema:
        out.append(F.when(there & ~F.to_json(at).isin(*(_json(x) for x in schema["enum"])), _error("ENUM", path)))
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if names:
            fits = _is(at, names[0])
            for n in names[1:]:
                fits = fits | _is(at, n)
            out.append(F.when(there & ~fits, _error("TYPE", path)))
    is_text, is_number = _is(at, "string"), _is(at, "number")
    for name, code, bad in (
        ("minLength", "TOO_SHORT", lambda n: is_text & (F.length(text) < n)), ("maxLength", "TOO_LONG", lambda n: is_text & (F.length(text) > n)),
        ("minimum", "TOO_SMALL", lambda n: is_number & (number < n)), ("maximum", "TOO_LARGE", lambda n: is_number & (number > n)),
    ):
        if name in schema:
            if not isinstance(schema[name], (int, float)):
                raise MalformedSchema(name)
            out.append(F.when(there & bad(schema[name]), _error(code, path)))
    is_object = there & _is(at, "object")
    for name in schema.get("required", []):
        out.append(F.when(is_object & F.try_variant_get(payload, place + _step(name), "variant").isNull(), _error("MISSING", f"{path}.{name}")))
    properties = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        held = F.map_keys(F.try_variant_get(payload, place, "map<string,variant>"))
        extra = F.array_except(held, F.array(*map(F.lit, properties)) if properties else F.array().cast("array<string>"))
        out.append(F.when(is_object & (F.size(extra) > 0), F.struct(F.lit("UNEXPECTED").alias("code"), F.concat(F.lit(f"{path}."), F.array_min(extra)).alias("path"))))
    for name in sorted(properties):
        out += checks(payload, properties[name], f"{path}.{name}", place + _step(name))
    if "items" in schema:
        items = F.try_variant_get(payload, place, "array<variant>")
        first = F.transform(items, lambda x, i: F.coalesce(*(_moved(c, path, i) for c in checks(x, schema["items"], "$"))))
        out.append(F.get(F.filter(first, lambda e: e.isNotNull()), F.lit(0)))
    return out


def _moved(error: Column, path: str, i: Column) -> Column:
    return F.when(error.isNotNull(), F.struct(error["code"].alias("code"), F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"), F.substring(error["path"], 2, 1 << 30)).alias("path")))


def _json(x) -> str:
    import json

    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def validated(text: Column, schema: dict) -> Column:
    """(code, path) of a JSON text's first error, null if it has none."""
    payload = F.try_parse_json(text)
    found = checks(payload, schema)
    return F.when(payload.isNull(), _error("JSON_PARSE", "$")).otherwise(F.coalesce(*found) if found else F.lit(None))


def envelope(contract: str, value: Column, kind: str = "json", port: str | None = None, producer: Column | None = None) -> Column:
    if kind not in MEDIA:
        raise MalformedSchema(f"payload kind {kind}")
    return F.struct(F.lit(contract).alias("contract"), F.lit(port).alias("port"), F.lit(kind).alias("payload_kind"), F.lit(MEDIA[kind]).alias("media_type"), (producer if producer is not None else F.lit(None).cast("string")).alias("producer"), value.alias("value"))


def unwrapped(*envelopes: Column) -> Column:
    """The value of one envelope as itself, those of several as an array; how many there are is known while planning."""
    return envelopes[0]["value"] if len(envelopes) == 1 else F.array(*(e["value"] for e in envelopes))


def invalid_examples(spark, contracts: dict[str, tuple[dict, list]]) -> DataFrame:
    """Registered examples (contract -> schema, examples) that their own schema refuses: contract, number, code, path."""
    out = None
    for name, (schema, examples) in contracts.items():
        rows = spark.createDataFrame([(name, k, _json(x)) for k, x in enumerate(examples)], "contract string, number int, text string")
        found = rows.withColumn("e", validated(F.col("text"), schema)).where("e is not null").select("contract", "number", "e.code", "e.path")
        out = found if out is None else out.unionAll(found)
    return out


def egress(outputs: dict[str, tuple[str, Column]], chosen: str | None = None, variant: bool = False) -> Column:
    """Envelopes of a node's outputs (label -> contract, value): a single one wraps itself, of several `chosen` names one; without it all
    go out together, unless the node gives one variant of them."""
    if chosen is not None and chosen not in outputs:
        raise MalformedSchema(f"output {chosen}")
    if len(outputs) == 1 or chosen is not None:
        label = chosen or next(iter(outputs))
        return envelope(outputs[label][0], outputs[label][1], port=label)
    if variant:
        raise MalformedSchema("a variant needs exactly one label")
    return F.struct(*(envelope(c, v, port=k).alias(k) for k, (c, v) in outputs.items()))
