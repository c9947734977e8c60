"""Cross-host correlation patterns.

Every pattern yields at most one row. The hosts it touches can be many, so they are a second table,
``(correlation_id, system_id)``, instead of an array that one task would have to collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.clock import minutes_between

# Fault keywords per pattern role.
KEYWORDS = {
    "db": ("db", "disk"),
    "api": ("api", "service", "crash"),
    "network": ("network", "drop"),
    "crash": ("crash", "service"),
    "auth": ("auth",),
}
AUTH_MINUTES = 10


def has_type(words: tuple[str, ...]) -> Column:
    fault, predicted = F.lower("fault_type"), F.lower(F.coalesce("predicted_fault", F.lit("")))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(fault, F.lit(w)) | F.contains(predicted, F.lit(w))
    return hit


def _first(hit: Column, newest: bool = False) -> Column:
    """Earliest (or newest) incident of a role: an aggregate, not a sort."""
    value = F.when(hit, F.struct("created_at", "incident_key", "fault_type", "system_id"))
    return F.max(value) if newest else F.min(value)


def hot_hosts(snapshots: DataFrame, cpu: float = 85) -> DataFrame:
    """Hosts with a snapshot above the CPU limit: time of the newest one and their number."""
    return snapshots.filter(F.col("cpu_usage_percent") > cpu).groupBy("system_id").agg(F.max("snapshot_time").alias("hot_at"), F.count(F.lit(1)).alias("hot_snapshots"))


def newest_predictions(predictions: DataFrame) -> DataFrame:
    """Newest probability and fault per host, as (model_host, m)."""
    return predictions.groupBy(F.col("system_id").alias("model_host")).agg(
        F.max_by(F.struct(F.col("failure_probability").cast("double").alias("p"), F.col("predicted_fault").alias("fault")), "prediction_time").alias("m")
    )


def correlation_facts(incidents: DataFrame, predictions: DataFrame, snapshots: DataFrame, systems: DataFrame, words: dict = KEYWORDS) -> DataFrame:
    """Everything the five patterns ask about, as one row.

    The incidents are read once: they meet the per-host flag of hot snapshots and are reduced by one global
    aggregate. The other inputs are one-row aggregates or one row per host, looked up for a single host.
    """
    hot = hot_hosts(snapshots)
    flagged = incidents.join(hot.select("system_id", F.lit(True).alias("hot")), "system_id", "left")
    one = flagged.agg(
        F.count(F.lit(1)).alias("incidents"),
        _first(has_type(words["db"])).alias("db"),
        _first(has_type(words["api"])).alias("api"),
        _first(has_type(words["crash"])).alias("crash"),
        _first(has_type(words["auth"]), newest=True).alias("auth"),
        F.count_if(has_type(words["network"])).alias("net"),
        F.countDistinct(F.when(has_type(words["network"]), F.col("system_id"))).alias("net_hosts"),
        F.count_if(F.coalesce("hot", F.lit(False))).alias("on_hot_hosts"),
        # An incident has one host, so a host common to all of them is the only one there is.
        F.when(F.min("system_id") == F.max("system_id"), F.min("system_id")).alias("common"),
    )
    busy = snapshots.filter(F.col("critical_count") > 5).groupBy(F.col("system_id").alias("busy_host")).agg(
        F.max_by("critical_count", "snapshot_time").alias("busy_count")
    )
    newest = newest_predictions(predictions)
    top_hot = hot.agg(F.max(F.struct("hot_at", F.col("system_id").alias("host"))).alias("r"), F.sum("hot_snapshots").alias("n"))
    cpu = systems.agg(F.avg(F.col("cpu_usage_percent").cast("double")))
    return (
        one.join(busy, F.col("db.system_id") == F.col("busy_host"), "left")
        .join(newest, F.col("common") == F.col("model_host"), "left")
        .withColumns({"fleet_cpu": cpu.scalar(), "hot_root": top_hot.select("r.host").scalar(), "hot_count": top_hot.select("n").scalar()})
    )


def _pattern(name: str, pattern: str, applies: Column, cause: Column, root: Column, conf: Column, evidence: list[Column]) -> Column:
    row = F.struct(
        F.lit(name).alias("correlation_id"),
        F.lit(pattern).alias("pattern"),
        cause.alias("root_cause"),
        root.cast("string").alias("root_system"),
        F.round(conf.cast("double"), 6).alias("confidence"),
        F.array_compact(F.array(*evidence)).alias("evidence"),
    )
    return F.when(applies, row)


def db_api_cascade() -> Column:
    """A storage incident and an API or service incident; stronger when the storage one came first."""
    db, api = F.col("db"), F.col("api")
    boosted = F.col("busy_host").isNotNull()
    conf = F.least(F.when(db["created_at"] <= api["created_at"], 0.72).otherwise(0.48) + F.when(boosted, 0.10).otherwise(0.0), F.lit(1.0))
    gap = F.round(minutes_between(db["created_at"], api["created_at"]), 1).cast("decimal(18,1)").cast("string")
    evidence = [
        F.concat(db["fault_type"], F.lit(" on ["), db["system_id"], F.lit("] started first")),
        F.concat(api["fault_type"], F.lit(" failures followed "), gap, F.lit("m later")),
        F.when(boosted, F.concat(F.lit("Feature snapshot: "), F.col("busy_count").cast("string"), F.lit(" critical events on "), F.col("busy_host"))),
    ]
    cause = F.concat(db["fault_type"], F.lit(" on "), db["system_id"], F.lit(" caused downstream API failures"))
    return _pattern("corr-db-api-cascade", "db_api_cascade", db.isNotNull() & api.isNotNull(), cause, db["system_id"], conf, evidence)


def cpu_exhaustion(fleet_limit: float = 80) -> Column:
    """Fleet CPU at or above the limit and incidents on hosts with a hot snapshot."""
    cpu = F.col("fleet_cpu")
    evidence = [
        F.concat(F.lit("Fleet avg CPU: "), F.floor(cpu + 0.5).cast("string"), F.lit("% (threshold: 80%)")),
        F.concat(F.col("hot_count").cast("string"), F.lit(" snapshots above 85% CPU")),
    ]
    conf = F.least(F.lit(0.65) + (cpu - 80) / 100, F.lit(0.90))
    cause = F.lit("CPU exhaustion causing cascading service degradation")
    applies = (cpu >= fleet_limit) & (F.col("on_hot_hosts") > 0)
    return _pattern("corr-cpu-exhaustion", "cpu_exhaustion", applies, cause, F.col("hot_root"), conf, evidence)


def network_degradation() -> Column:
    """Two or more network incidents on two or more hosts."""
    evidence = [
        F.concat(F.lit("Network incidents on "), F.col("net_hosts").cast("string"), F.lit(" systems simultaneously")),
        F.lit("Suggests upstream router/BGP or datacenter-level connectivity issue"),
    ]
    conf = F.least(F.lit(0.55) + F.col("net") * 0.05, F.lit(0.90))
    cause = F.lit("External network degradation affecting multiple systems")
    applies = (F.col("net") >= 2) & (F.col("net_hosts") >= 2)
    return _pattern("corr-network-degradation", "network_degradation", applies, cause, F.lit(None), conf, evidence)


def isolated_node() -> Column:
    """All of two or more incidents share exactly one host."""
    host, model = F.col("common"), F.col("m")
    percent = F.floor(model["p"] * 100 + 0.5).cast("string")
    evidence = [
        F.concat(F.lit("All "), F.col("incidents").cast("string"), F.lit(" incidents share single system: "), host),
        F.when(model.isNotNull(), F.concat(F.lit("ML failure probability: "), percent, F.lit("% — predicted: "), F.coalesce(model["fault"], F.lit("Unknown")))),
    ]
    conf = F.least(F.lit(0.70) + F.coalesce(model["p"], F.lit(0.0)) * 0.15, F.lit(0.95))
    cause = F.concat(F.lit("Isolated node failure: "), host)
    return _pattern("corr-isolated-node", "isolated_node", (F.col("incidents") >= 2) & host.isNotNull(), cause, host, conf, evidence)


def auth_after_crash(minutes: float = AUTH_MINUTES) -> Column:
    """The newest auth incident follows the earliest crash or service incident within the window."""
    crash, auth = F.col("crash"), F.col("auth")
    gap = minutes_between(crash["created_at"], auth["created_at"])
    host = crash["system_id"]
    evidence = [
        F.concat(crash["fault_type"], F.lit(" on "), host, F.lit(" at "), F.date_format(crash["created_at"], "HH:mm")),
        F.concat(F.lit("Auth failures followed "), F.round(gap, 1).cast("decimal(18,1)").cast("string"), F.lit("m later")),
        F.lit("Service restart likely invalidated in-flight sessions / JWT refresh tokens"),
    ]
    cause = F.concat(F.lit("Service crash on "), host, F.lit(" caused auth token invalidation"))
    applies = (crash["created_at"] <= auth["created_at"]) & (gap <= minutes)
    return _pattern("corr-auth-after-crash", "auth_after_crash", applies, cause, host, F.lit(0.68), evidence)


def patterns_of(facts: DataFrame, fleet_limit: float = 80, minutes: float = AUTH_MINUTES) -> DataFrame:
    """Patterns that apply to the facts row, most confident first."""
    rows = F.array_compact(F.array(db_api_cascade(), cpu_exhaustion(fleet_limit), network_degradation(), isolated_node(), auth_after_crash(minutes)))
    return facts.select(F.inline(rows)).orderBy(F.col("confidence").desc(), "correlation_id")


def correlate(
    incidents: DataFrame, predictions: DataFrame, snapshots: DataFrame, systems: DataFrame, words: dict = KEYWORDS, fleet_limit: float = 80, minutes: float = AUTH_MINUTES
) -> DataFrame:
    return patterns_of(correlation_facts(incidents, predictions, snapshots, systems, words), fleet_limit, minutes)


def isolated_nodes(incidents: DataFrame, predictions: DataFrame, by: list[str]) -> DataFrame:
    """The isolated-node pattern within every group of incidents that agree in ``by``: at most one row per group."""
    groups = incidents.groupBy(*by).agg(
        F.count(F.lit(1)).alias("incidents"), F.when(F.min("system_id") == F.max("system_id"), F.min("system_id")).alias("common")
    )
    groups = groups.select(F.struct(*by).alias("__group"), "incidents", "common")
    facts = groups.join(newest_predictions(predictions), F.col("common") == F.col("model_host"), "left")
    return facts.select("__group", isolated_node().alias("found")).filter("found IS NOT NULL").select("__group.*", "found.*")


def common_systems(incidents: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hosts that all incidents have in common: a host's distinct incidents against the number of all incidents.

    With ``by`` the same within every group of incidents that agree in those columns.
    """
    by = by or []
    group = F.struct(*by, F.lit(0).alias("__all"))  # a struct with NULL fields equals itself in a join
    rows = incidents.select(group.alias("__group"), "system_id", "incident_key").distinct()
    total = rows.select("__group", "incident_key").distinct().groupBy("__group").agg(F.count(F.lit(1)).alias("__total"))
    per_host = rows.groupBy("__group", "system_id").agg(F.count(F.lit(1)).alias("incidents"))
    shared = per_host.join(total, (per_host["__group"] == total["__group"]) & (F.col("incidents") == F.col("__total")), "left_semi")
    return shared.select(*[F.col(f"__group.{c}").alias(c) for c in by], "system_id", "incidents")


def correlation_systems(correlations: DataFrame, incidents: DataFrame, snapshots: DataFrame, words: dict = KEYWORDS) -> DataFrame:
    """(correlation_id, system_id) for every affected host, plus the root host."""
    roles = {
        "corr-db-api-cascade": has_type(words["db"]) | has_type(words["api"]),
        "corr-network-degradation": has_type(words["network"]),
        "corr-auth-after-crash": has_type(words["crash"]) | has_type(words["auth"]),
    }
    tags = F.array_compact(F.array(*[F.when(cond, name) for name, cond in roles.items()]))
    by_fault = incidents.select("system_id", F.explode(tags).alias("correlation_id"))
    hot = incidents.join(hot_hosts(snapshots).select("system_id"), "system_id", "left_semi").select(
        "system_id", F.lit("corr-cpu-exhaustion").alias("correlation_id")
    )
    roots = correlations.filter(F.col("root_system").isNotNull()).select(F.col("root_system").alias("system_id"), "correlation_id")
    members = by_fault.unionByName(hot).unionByName(roots).distinct()
    # At most five pattern ids, so they travel as one array value instead of a join side.
    found = correlations.agg(F.collect_list("correlation_id"))
    return members.filter(F.array_contains(found.scalar(), F.col("correlation_id"))).select("correlation_id", "system_id")


def incident_correlations(incidents: DataFrame, members: DataFrame) -> DataFrame:
    """Correlations that touch a host of the incident: an equi-join on the host."""
    return incidents.select("incident_key", "system_id").join(members, "system_id").select("incident_key", "correlation_id").distinct()
