"""JSON Schemas compiled to Column predicates that name what fails.

A value of a struct column is held against a schema inside the JVM: each rule becomes one expression that
gives the path of the failing place. What the column's type alone decides (missing or unknown
fields, wrong types) is found while compiling and named for every row. Understood are type,
properties, required, additionalProperties, items, enum, const, pattern, minimum and maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATHS = "array<string>"
#: Column types that hold the values of a JSON type.
HOLDS = {
    "string": (T.StringType,),
    "boolean": (T.BooleanType,),
    "integer": (T.IntegerType, T.LongType, T.ShortType, T.ByteType),
    "number": (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType),
    "array": (T.ArrayType,),
    "object": (T.StructType, T.MapType),
}


def failing(value: Column, kind: T.DataType, schema: dict, at: Column) -> Column:
    """The paths at which a value of a type breaks a schema, as an array."""
    wanted = schema.get("type", list(HOLDS) + ["null"])
    wanted = [wanted] if isinstance(wanted, str) else wanted
    if not any(isinstance(kind, HOLDS[w]) for w in wanted if w != "null"):
        return F.array(at)
    rules = []
    if "const" in schema:
        rules.append(value != F.lit(schema["const"]))
    if "enum" in schema:
        rules.append(~value.isin([x for x in schema["enum"] if x is not None]))
    if "pattern" in schema:
        rules.append(~value.rlike(schema["pattern"]))
    if "minimum" in schema:
        rules.append(value < schema["minimum"])
    if "maximum" in schema:
        rules.append(value > schema["maximum"])
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        rules.append(F.isnan(value))
    broken = F.lit(False)
    for rule in rules:
        broken = broken | rule
    own = F.when(value.isNull(), F.array().cast(PATHS) if "null" in wanted else F.array(at)).when(broken, F.array(at)).otherwise(F.array().cast(PATHS))
    inner = inside(value, kind, schema, at)
    return own if inner is None else F.concat(own, F.when(value.isNotNull(), inner).otherwise(F.array().cast(PATHS)))


def inside(value: Column, kind: T.DataType, schema: dict, at: Column) -> Column | None:
    if isinstance(kind, T.ArrayType) and "items" in schema:
        return F.flatten(F.transform(value, lambda x, i: failing(x, kind.elementType, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
    more = schema.get("additionalProperties", True)
    if isinstance(kind, T.MapType) and isinstance(more, dict):
        entries = F.map_entries(value)
        return F.flatten(F.transform(entries, lambda e: failing(e["value"], kind.valueType, more, F.concat(at, F.lit("."), e["key"].cast("string")))))
    if isinstance(kind, T.StructType):
        known = schema.get("properties", {})
        names = set(kind.fieldNames())
        absent = [n for n in schema.get("required", []) if n not in names] + ([n for n in kind.fieldNames() if n not in known] if more is False else [])
        # a field that isn't required may be null, which is how a struct leaves it out
        held = {n: known[n] if n in schema.get("required", []) else optional(known[n]) for n in known if n in names}
        parts = [F.array(*[F.concat(at, F.lit("." + n)) for n in absent])] if absent else []
        parts += [failing(value[n], kind[n].dataType, s, F.concat(at, F.lit("." + n))) for n, s in held.items()]
        return F.concat(*parts) if parts else None
    return None


def optional(schema: dict) -> dict:
    wanted = schema.get("type", list(HOLDS))
    return {**schema, "type": [*([wanted] if isinstance(wanted, str) else wanted), "null"]}


def violations(rows: DataFrame, column: str, schema: dict) -> DataFrame:
    """rows with violations: the paths (from $) at which a struct column breaks a schema, in order of the schema."""
    return rows.withColumn("violations", failing(F.col(column), rows.schema[column].dataType, schema, F.lit("$")))


def of(**properties) -> dict:
    """An object of these properties, all required, and of no others."""
    return {"type": "object", "required": list(properties), "properties": properties, "additionalProperties": False}


STRING, COUNT, SHARE, TEXTS = {"type": "string"}, {"type": "integer", "minimum": 0}, {"type": "number", "minimum": 0, "maximum": 1}, {"type": "array", "items": {"type": "string"}}
SUM = {"type": "string", "pattern": "^(sha256:[0-9a-f]{64})?$"}

# The manifest as operators.manifest writes it.
MANIFEST = of(
    schema_version={"type": "string", "const": "1.0"}, selection_logic_version=STRING, version=STRING, config_digest=SUM, scope=STRING,
    repo=of(root=STRING, fingerprint=SUM, language_hints=TEXTS),
    language_tiers={"type": "object", "additionalProperties": {"type": "string", "enum": ["tier1_deep", "tier2_structural", "tier3_lexical"]}},
    incomplete={"type": "boolean"}, task_id=STRING,
    task=of(source=STRING, type={"type": "string", "enum": ["bugfix", "feature", "refactor", "test-addition", "documentation", "investigation", "migration", "unknown"]}, objective=STRING, anchors=TEXTS, raw_text=STRING, **dict.fromkeys(["expects_tests", "expects_config", "expects_docs", "expects_migration", "expects_api"], {"type": "boolean"})),
    budget=of(budget=COUNT, spent=COUNT, model=STRING, token_ceiling=COUNT, estimator=STRING, estimator_version=STRING, reserved=of(instructions=COUNT, reasoning=COUNT, tool_output=COUNT, expansion=COUNT)),
    selections={"type": "array", "items": of(path=STRING, load_mode={"type": "string", "enum": ["full", "structural_summary", "behavioral_summary"]}, relevance_score=SHARE, estimated_tokens=COUNT, demoted_reason={"type": ["string", "null"]}, rationale=TEXTS)},
    reachable={"type": "array", "items": of(path=STRING, relevance_score=SHARE, reason=STRING)},
    supplementals={"type": "array", "items": of(category=STRING, path=STRING)},
    exclusions={"type": "array", "items": of(path=STRING, reason={"type": "string", "enum": ["default_pattern", "user_pattern", "binary", "oversize_cutoff", "hidden_dir", "symlink", "read_error"]})},
    gaps={"type": "array", "items": of(id={"type": "string", "pattern": "^gap-[0-9]+$"}, type=STRING, severity={"type": "string", "enum": ["info", "warning", "blocking"]}, description=STRING, suggested_remediation=TEXTS)},
    feasibility=of(score=SHARE, assessment=STRING, sub_signals=of(coverage=SHARE, anchor_resolution=SHARE, task_specificity=SHARE, budget_headroom=SHARE, gap_penalty=SHARE), positives=TEXTS, negatives=TEXTS, blocking_conditions=TEXTS),
    breakdowns={"type": "array", "items": of(path=STRING, breakdown={"type": "array", "items": of(factor=STRING, signal=SHARE, weight=SHARE, contribution=SHARE)})},
)
