"""Alert rules stored as text: parse, resolve fields, match events, count recent matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.coerce import number_from_text, strip
from fleetsight.functions.ordered import trailing_count
from fleetsight.schemas import RULE_LOOKBACK_SECONDS

# Fixed patterns. With ``=`` before ``==`` a double-equals condition parses as ``=`` with the value ``= ..`` and so
# never matches a number; the second pattern is the corrected order.
CONDITION = r"^\s*([a-zA-Z0-9_\.]+)\s*(>=|<=|!=|=|==|>|<|contains)\s*(.+?)\s*$"
CONDITION_FIXED = r"^\s*([a-zA-Z0-9_\.]+)\s*(>=|<=|!=|==|=|>|<|contains)\s*(.+?)\s*$"

# Short names for event columns.
ALIASES = {
    "cpu": "cpu_usage_percent",
    "cpu_usage": "cpu_usage_percent",
    "memory": "memory_usage_percent",
    "mem": "memory_usage_percent",
    "disk": "disk_free_percent",
    "disk_free": "disk_free_percent",
    "message": "normalized_message",
    "provider": "provider_name",
}

# Columns a rule can see, on a live event, when counting earlier matches, and in a backfill.
LIVE_FIELDS = [
    "id", "system_id", "hostname", "provider_name", "severity", "fault_type", "diagnostic_context", "ingested_at",
    "event_record_id", "event_hash", "cpu_usage_percent", "memory_usage_percent", "disk_free_percent",
    "event_message", "parsed_message", "normalized_message", "fault_subtype",
]
COUNTED_FIELDS = [
    "system_id", "severity", "fault_type", "fault_subtype", "provider_name", "diagnostic_context",
    "cpu_usage_percent", "memory_usage_percent", "disk_free_percent", "normalized_message",
]

#: Parsed rules up to this number are broadcast; more are spread over salted copies of their field.
BROADCAST_RULES = 20_000
#: Keys of the diagnostic object are picked out by name up to this number of names in rules; beyond it all keys are read.
NAMED_KEYS = 1_000
#: Parts that the events of one field are dealt to when the rules are not broadcast.
SALTS = 32
EQUALITY = ("=", "==")
NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def parse_rules(rules: DataFrame, fix_double_equals: bool = False) -> DataFrame:
    """Adds field, op and expected; malformed conditions are dropped."""
    pattern = CONDITION_FIXED if fix_double_equals else CONDITION
    text = F.coalesce(strip(F.col("condition")), F.lit(""))
    parts = rules.withColumns({n: F.regexp_extract(text, pattern, i) for i, n in enumerate(("raw_field", "op", "raw_value"), 1)})
    parts = parts.filter(F.col("op") != "")
    field = F.lower(strip(F.col("raw_field")))
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return parts.withColumns(
        {
            "field": F.coalesce(F.try_element_at(aliases, field), field),
            "expected": F.regexp_replace(strip(F.col("raw_value")), "^['\"]+|['\"]+$", ""),
        }
    ).drop("raw_field", "raw_value")


def _as_text(events: DataFrame, name: str) -> Column:
    kind = events.schema[name].dataType.typeName()
    c = F.col(name)
    return (c.cast("double") if kind in ("decimal", "float", "double") else c).cast("string")


def context_value(events: DataFrame, name: str, fields: list[str] = LIVE_FIELDS) -> Column:
    """Text value of a field: the column if the row has it, else that key of the diagnostic JSON object."""
    if name in fields and name in events.columns:
        return strip(_as_text(events, name))
    if name in fields:
        return F.lit(None).cast("string")
    return strip(F.get_json_object("diagnostic_context", f"$['{name}']"))


def context_number(events: DataFrame, name: str, fields: list[str] = LIVE_FIELDS) -> Column:
    """Numeric value of a field, NULL if its text is not a number. Numeric columns skip the way through text."""
    if name in fields and name in events.columns and events.schema[name].dataType.typeName() in NUMERIC:
        return F.col(name).cast("double")
    return number_from_text(context_value(events, name, fields))


def condition_holds(actual: Column, op: Column, expected: Column, a: Column | None = None, b: Column | None = None) -> Column:
    """``contains`` ignores case; two numbers compare as numbers, anything else as lower-cased text.

    ``a`` and ``b`` are the two values as numbers if the caller has them already.
    """
    a = number_from_text(actual) if a is None else a
    b = number_from_text(expected) if b is None else b
    ta, tb = F.lower(actual), F.lower(expected)

    def compare(x: Column, y: Column) -> Column:
        return (
            F.when(op.isin("=", "=="), x == y)
            .when(op == "!=", x != y)
            .when(op == ">", x > y)
            .when(op == "<", x < y)
            .when(op == ">=", x >= y)
            .when(op == "<=", x <= y)
            .otherwise(F.lit(False))
        )

    numeric = a.isNotNull() & b.isNotNull()
    found = F.when(op == "contains", F.contains(ta, tb)).when(numeric, compare(a, b)).otherwise(compare(ta, tb))
    return F.coalesce(found, F.lit(False))


def _diagnostic_pair(key: Column) -> Column:
    """(field, actual, actual_number) of one key of the diagnostic object."""
    value = strip(F.call_function("get_json_object", F.col("diagnostic_context"), F.concat(F.lit("$['"), key, F.lit("']"))))
    return F.struct(key.alias("field"), value.alias("actual"), number_from_text(value).alias("actual_number"))


def _lookups(by_field: Column, by_value: Column, text: Column, number: Column) -> Column:
    """Keys under which a rule and a value of its field meet: none but the field, the lower-cased text, the number."""
    as_number = F.when(number == 0, F.lit(0.0)).otherwise(number).cast("string")
    return F.array_compact(
        F.array(
            F.when(by_field, F.lit("*")),
            F.when(by_value, F.concat(F.lit("t"), F.lower(text))),
            F.when(by_value, F.concat(F.lit("n"), as_number)),
        )
    )


def match_rules(
    events: DataFrame, rules: DataFrame, keep: list[str], fields: list[str] = LIVE_FIELDS, fix_double_equals: bool = False
) -> DataFrame:
    """Every (event, enabled rule) pair whose condition holds.

    Not a cross join: an event becomes one (field, value) row per field that some rule names, and those rows meet
    the rules on the field name. A name is a column (only those that rules use are unpivoted) or a key of the
    event's diagnostic JSON object. Equality rules meet only the rows that hold their value: they are looked up by
    field and value, once as text and once as number, where rules of the other operators are looked up by field.
    Rules are broadcast up to ``BROADCAST_RULES``; beyond that the few field names are no fit shuffle keys, so the
    events of a field go to ``SALTS`` parts and the rules to each of them.
    """
    enabled = rules.filter(F.coalesce("enabled", F.lit(True))) if "enabled" in rules.columns else rules
    parsed = parse_rules(enabled, fix_double_equals)
    is_column = F.col("field").isin(*fields)
    equal = F.col("op").isin(*EQUALITY)
    outside = F.when(~is_column, F.col("field"))
    n, by_value, by_field, others = parsed.agg(
        F.count(F.lit(1)),
        F.collect_set(F.when(is_column & equal, F.col("field"))),
        F.collect_set(F.when(is_column & ~equal, F.col("field"))),
        F.count_distinct(outside),
    ).first()
    pairs = [
        F.struct(
            F.lit(name).alias("field"),
            context_value(events, name, fields).alias("actual"),
            context_number(events, name, fields).alias("actual_number"),
        )
        for name in sorted({*by_value, *by_field})
    ]
    listed = F.array(*pairs) if pairs else F.array().cast("array<struct<field:string,actual:string,actual_number:double>>")
    if others and "diagnostic_context" in events.columns:
        keys = F.coalesce(F.array_distinct(F.json_object_keys("diagnostic_context")), F.array().cast("array<string>"))
        if others <= NAMED_KEYS:
            names = parsed.agg(F.collect_set(outside)).first()[0]
            asked = F.array_intersect(keys, F.array(*[F.lit(name) for name in sorted(names)]))
        else:
            asked = F.filter(keys, lambda k: ~k.isin(*fields))
        listed = F.concat(listed, F.transform(asked, _diagnostic_pair))
    values = events.select(*keep, F.inline(listed)).filter(F.col("actual").isNotNull())
    elsewhere = ~F.col("field").isin(*fields)
    values = values.select(
        "*",
        F.explode(
            _lookups(
                elsewhere | F.col("field").isin(*by_field),
                elsewhere | F.col("field").isin(*by_value),
                F.col("actual"),
                F.col("actual_number"),
            )
        ).alias("__lookup"),
    )
    rule_side = parsed.select(
        F.col("id").alias("rule_id"),
        "rule_name",
        "condition",
        F.col("severity").alias("rule_severity"),
        "threshold",
        *[c for c in ("cooldown_minutes", "escalation_target") if c in parsed.columns],
        "field",
        "op",
        "expected",
        number_from_text(F.col("expected")).alias("expected_number"),
    )
    rule_side = rule_side.select("*", F.explode(_lookups(~equal, equal, F.col("expected"), F.col("expected_number"))).alias("__lookup"))
    if n <= BROADCAST_RULES:
        joined = values.join(F.broadcast(rule_side), ["field", "__lookup"])
    else:
        part = F.pmod(F.xxhash64(*keep, "actual"), F.lit(SALTS))
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
        joined = values.withColumn("__part", part).join(rule_side.withColumn("__part", copies), ["field", "__lookup", "__part"]).drop("__part")
    holds = condition_holds(F.col("actual"), F.col("op"), F.col("expected"), F.col("actual_number"), F.col("expected_number"))
    # Two equal numbers meet by number, and where their texts are equal by text too: that row goes.
    twice = F.startswith("__lookup", F.lit("t")) & F.col("actual_number").isNotNull() & F.col("expected_number").isNotNull()
    return joined.filter(holds & ~twice).drop("actual_number", "expected_number", "__lookup")


def firing_matches(
    matches: DataFrame, lookback_seconds: int = RULE_LOOKBACK_SECONDS, live_fields_only: bool = False, ts: str = "ingested_at"
) -> DataFrame:
    """Matches with their trailing count per (rule, host) that reach the rule's threshold.

    ``live_fields_only`` reproduces the narrow candidate row: rules on any other event column count zero and
    never fire.
    """
    rows = matches
    if live_fields_only:
        hidden = [f for f in LIVE_FIELDS if f not in COUNTED_FIELDS]
        rows = rows.filter(~F.col("field").isin(*hidden))
    counted = trailing_count(rows, ["rule_id", "system_id"], ts, lookback_seconds, out="recent")
    return counted.filter(F.col("recent") >= F.greatest(F.lit(1), F.coalesce("threshold", F.lit(1))))
