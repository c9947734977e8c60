"""Fault classification, the knowledge base and error detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.functions.severity import level_name
from fleetsight.functions.xml import with_description
from fleetsight.operators.shaping import collected_level
from fleetsight.schemas import CPU_ALERT, DISK_ALERT, MEMORY_ALERT

# Fixed values, in order: (provider substring, event code or None, fault type). The first hit wins.
CLASSIFICATION = [
    ("Kernel-Power", 41, "SYSTEM_FAULT"),
    ("Kernel-Power", 109, "SYSTEM_FAULT"),
    ("BugCheck", None, "SYSTEM_FAULT"),
    ("BlueScreen", None, "SYSTEM_FAULT"),
    ("WER-SystemErrorReporting", None, "SYSTEM_FAULT"),
    ("Kernel-PnP", 219, "DRIVER_ISSUE"),
    ("DriverFrameworks", None, "DRIVER_ISSUE"),
    ("Kernel-Processor-Power", 37, "RESOURCE_WARNING"),
    ("disk", 153, "RESOURCE_WARNING"),
    ("Resource-Exhaustion", None, "RESOURCE_WARNING"),
    ("Service Control Manager", 7000, "SERVICE_ERROR"),
    ("Service Control Manager", 7001, "SERVICE_ERROR"),
    ("Service Control Manager", 7009, "SERVICE_ERROR"),
    ("Service Control Manager", 7023, "SERVICE_ERROR"),
    ("Service Control Manager", 7031, "SERVICE_ERROR"),
    ("Service Control Manager", 7034, "SERVICE_ERROR"),
    ("winsrvext", None, "SERVICE_ERROR"),
    ("DistributedCOM", 10016, "SECURITY_EVENT"),
    ("WindowsUpdateClient", None, "UPDATE_ERROR"),
    ("Volsnap", None, "STORAGE_ERROR"),
    ("Ntfs", None, "STORAGE_ERROR"),
    ("DistributedCOM", None, "SECURITY_EVENT"),
    ("Netwtw14", None, "DRIVER_ISSUE"),
    ("TPM-WMI", None, "SECURITY_EVENT"),
    ("Hyper-V", None, "DRIVER_ISSUE"),
    ("NDIS", None, "DRIVER_ISSUE"),
    ("Win32k", None, "SYSTEM_FAULT"),
    ("Application-Experience", None, "SERVICE_ERROR"),
    ("UserModePowerService", None, "RESOURCE_WARNING"),
    ("Time-Service", None, "SERVICE_ERROR"),
    ("Server", None, "SERVICE_ERROR"),
    ("TPM", None, "SECURITY_EVENT"),
    ("WHEA-Logger", None, "SYSTEM_FAULT"),
]

# Description per fault type.
FAULT_DESCRIPTIONS = {
    "SYSTEM_FAULT": "Critical system fault (crash, BSOD, unexpected shutdown)",
    "DRIVER_ISSUE": "Device driver failure or timeout",
    "RESOURCE_WARNING": "Resource exhaustion or performance degradation",
    "SERVICE_ERROR": "Windows service start/stop failure",
    "SECURITY_EVENT": "Permission violation or security-related event",
    "UPDATE_ERROR": "Windows Update failure",
    "STORAGE_ERROR": "Disk or volume shadow copy issues",
    "UNKNOWN": "Unclassified event",
}

# Fixed values, in order: (keyword, fault subtype, title).
KEYWORDS = [
    ("crash", "CRASH", "Application Crash"),
    ("hang", "HANG", "Application Hang"),
    ("timeout", "TIMEOUT", "Operation Timeout"),
    ("fail", "FAILURE", "General Failure"),
    ("error", "ERROR", "Reported Error"),
    ("exception", "EXCEPTION", "Unhandled Exception"),
    ("disk", "STORAGE", "Disk-Related Event"),
    ("memory", "MEMORY", "Memory-Related Event"),
    ("driver", "DRIVER", "Driver-Related Event"),
    ("service", "SERVICE", "Service-Related Event"),
    ("network", "NETWORK", "Network-Related Event"),
    ("security", "SECURITY", "Security-Related Event"),
    ("update", "UPDATE", "Update-Related Event"),
    ("power", "POWER", "Power-Related Event"),
]

KNOWLEDGE_DDL = (
    "kb_order int, kb_provider string, kb_code int, title string, diagnosis string, causes array<string>, solutions array<string>"
)

# Fixed values: (provider, event code or None, title, diagnosis, causes, solutions).
KNOWLEDGE = [
    (
        "Microsoft-Windows-Kernel-Power", 41, "Unexpected Shutdown / BSOD",
        "System experienced an unexpected shutdown or blue screen.",
        ["Hardware failure (RAM, PSU, motherboard)", "Driver compatibility issue", "Overheating causing thermal shutdown", "Power supply instability"],
        ["Check Windows Reliability Monitor for crash details", "Run memory diagnostic: mdsched.exe", "Check Event Viewer for related BugCheck events", "Monitor CPU/GPU temperatures under load"],
    ),
    (
        "Microsoft-Windows-Kernel-Power", 109, "Kernel Power Shutdown",
        "The kernel power manager initiated a system shutdown or restart.",
        ["Planned or unexpected system shutdown", "Power loss event"],
        ["Verify if shutdown was planned", "Check UPS / power supply health"],
    ),
    (
        "Microsoft-Windows-Kernel-PnP", 219, "Driver Start Timeout",
        "A driver failed to start within the allotted time.",
        ["Device driver slow to initialize", "Hardware not responding", "Driver compatibility issue with current Windows version"],
        ["Update the device driver to the latest version", "Check Windows Update for driver updates", "Verify hardware is functioning correctly (Device Manager)", "Consider disabling fast startup if issue persists"],
    ),
    (
        "Microsoft-Windows-Kernel-Processor-Power", 37, "CPU Thermal Throttling",
        "Processor speed was limited by system firmware.",
        ["CPU overheating", "Power management settings limiting CPU performance", "BIOS/UEFI power limits being enforced", "Battery saving mode active (laptops)"],
        ["Check CPU temperatures and improve cooling", "Review power plan settings (High Performance vs Balanced)", "Update BIOS/UEFI to latest version", "Ensure adequate power supply for the system"],
    ),
    (
        "Microsoft-Windows-DistributedCOM", 10016, "DCOM Permission Violation",
        "Application-specific permission settings do not grant Local Activation permission.",
        ["Default DCOM permissions restrict certain apps from starting COM servers", "Security hardening removed necessary permissions"],
        ["Usually benign — can be safely ignored", "If problematic: use Component Services (dcomcnfg) to adjust permissions", "Identify the CLSID/AppID in event details and grant appropriate permissions"],
    ),
    (
        "Service Control Manager", 7000, "Service Start Failure",
        "A Windows service failed to start.",
        ["Missing service dependencies", "Corrupted service binary", "Permission issue"],
        ["Check service dependencies in services.msc", "Repair or reinstall the affected service", "Run: sfc /scannow"],
    ),
    (
        "Service Control Manager", 7001, "Service Dependency Failure",
        "A service failed to start due to a dependency not being available.",
        ["Dependent service not running", "Startup order issue"],
        ["Check dependent service status", "Review service startup order"],
    ),
    (
        "Service Control Manager", 7009, "Service Start Timeout",
        "A service did not respond to the start request in a timely fashion.",
        ["Service is hung during initialization", "Resource contention at boot"],
        ["Increase service timeout in registry if appropriate", "Check service logs"],
    ),
    (
        "Service Control Manager", 7023, "Service Terminated with Error",
        "A service terminated with an error code.",
        ["Application bug", "Missing DLL or resource"],
        ["Check application-specific logs", "Reinstall the affected application"],
    ),
    (
        "Service Control Manager", 7031, "Service Crash and Restart",
        "A service terminated unexpectedly and was scheduled for restart.",
        ["Software bug", "Resource exhaustion", "Dependency failure"],
        ["Check service-specific event logs", "Review memory and CPU usage", "Update the affected service or application"],
    ),
    (
        "Service Control Manager", 7034, "Service Unexpected Termination",
        "A service terminated unexpectedly without a restart.",
        ["Application crash", "Out of memory", "Unhandled exception"],
        ["Check Application event log for crash details", "Review Windows Error Reporting crash dumps", "Consider increasing available memory"],
    ),
    (
        "Microsoft-Windows-WindowsUpdateClient", 20, "Windows Update Installation Failure",
        "A Windows Update installation failed.",
        ["Insufficient disk space for update", "Corrupted Windows Update components", "Third-party software interference", "System file corruption"],
        ["Run Windows Update Troubleshooter", "Run: DISM /Online /Cleanup-Image /RestoreHealth", "Run: sfc /scannow", "Clear update cache: delete contents of C:\\Windows\\SoftwareDistribution", "Ensure 10GB+ free disk space"],
    ),
    (
        "Volsnap", 25, "Volume Shadow Copy Failure",
        "Shadow copies were aborted due to insufficient resources.",
        ["Low disk space for shadow storage", "VSS service configuration issues", "Disk I/O bottleneck during snapshot"],
        ["Free disk space on the affected volume", "Resize shadow storage: vssadmin resize shadowstorage", "Delete old shadow copies: vssadmin delete shadows", "Check disk health with chkdsk"],
    ),
    (
        "disk", 153, "Disk I/O Delay",
        "An I/O operation encountered an unusually long delay.",
        ["Failing or degraded hard drive", "Insufficient disk throughput (spinning HDD)", "Background processes causing disk contention"],
        ["Run: chkdsk /f /r", "Check SMART status with CrystalDiskInfo or similar", "Consider upgrading to SSD", "Update storage controller drivers"],
    ),
    (
        "Microsoft-Windows-Hyper-V-Hypervisor", 167, "Hypervisor Active",
        "Hypervisor detected during boot (informational).",
        ["Hyper-V or WSL2 enabled", "Virtualization-based security active"],
        ["No action needed if virtualization is intentional", "Disable Hyper-V via Windows Features if not required"],
    ),
    (
        "Netwtw14", 5002, "Intel WiFi Driver Event",
        "Network adapter encountered an issue.",
        ["WiFi driver instability", "Network interference or weak signal", "Power management settings disabling WiFi adapter"],
        ["Update Intel WiFi driver to latest version", "Disable WiFi power management in Device Manager", "Switch to 5GHz band if on 2.4GHz"],
    ),
    (
        "winsrvext", None, "Windows Service Extension Event",
        "Service-related configuration or state change.",
        ["Service startup/shutdown", "Scheduled maintenance task"],
        ["Generally informational — no action required", "Check services.msc if service is critical"],
    ),
]

CHECK_VIEWER = "Check Event Viewer for details"


def classify_fault(provider: Column, code: Column, level: Column) -> Column:
    """First matching rule; an unmatched event falls back by level."""
    lowered = F.lower(F.coalesce(provider, F.lit("")))
    expr = None
    for needle, wanted, fault in CLASSIFICATION:
        hit = F.contains(lowered, F.lit(needle.lower()))
        if wanted is not None:
            hit = hit & F.coalesce(code == wanted, F.lit(False))
        expr = F.when(hit, fault) if expr is None else expr.when(hit, fault)
    return expr.when(level == 1, "SYSTEM_FAULT").when(level == 2, "SERVICE_ERROR").otherwise("UNKNOWN")


def describe_fault(fault: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FAULT_DESCRIPTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, fault), F.lit("Unknown"))


def classified(events: DataFrame, provider: str = "provider_name", code: str = "event_code", level: str = "level") -> DataFrame:
    """Adds class_fault, class_description and class_severity.

    The rules depend on (provider, code, level) only, but evaluating them per row keeps the plan free of shuffles.
    """
    rows = events.withColumn("class_fault", classify_fault(F.col(provider), F.col(code), F.col(level)))
    return rows.withColumns(
        {
            "class_description": describe_fault(F.col("class_fault")),
            "class_severity": level_name(F.col(level), F.lit("INFO")),
        }
    )


def keyword_class(text: Column) -> Column:
    """Struct (keyword, subtype, title) of the first keyword contained in the lower-cased text, else NULL."""
    lowered = F.lower(text)
    expr = None
    for keyword, subtype, title in KEYWORDS:
        value = F.struct(F.lit(keyword).alias("keyword"), F.lit(subtype).alias("subtype"), F.lit(title).alias("title"))
        hit = F.contains(lowered, F.lit(keyword))
        expr = F.when(hit, value) if expr is None else expr.when(hit, value)
    return expr


def classify_unknown(rows: DataFrame, provider: Column, message: Column, code: Column) -> DataFrame:
    """Keyword fallback: confidence 0.5 on a hit, else 0.2 and a generic title."""
    text = F.concat(F.coalesce(provider, F.lit("")), F.lit(" "), F.coalesce(message, F.lit("")))
    hit = F.col("__kw")
    found = rows.withColumn("__kw", keyword_class(text))
    number = F.coalesce(code.cast("string"), F.lit("0"))
    return found.withColumns(
        {
            "kw_title": F.coalesce(hit["title"], F.concat(F.lit("Unknown Event "), number)),
            "kw_diagnosis": F.when(
                hit.isNotNull(), F.concat(F.lit("Keyword match '"), hit["keyword"], F.lit("' in provider/message."))
            ).otherwise(
                F.concat(F.lit("No classification available for "), F.coalesce(provider, F.lit("")), F.lit(" EventID "), number, F.lit("."))
            ),
            "kw_subtype": F.coalesce(hit["subtype"], F.lit("UNKNOWN")),
            "kw_confidence": F.when(hit.isNotNull(), 0.5).otherwise(0.2),
        }
    ).drop("__kw")


def knowledge_base(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(KNOWLEDGE)], KNOWLEDGE_DDL)


def with_knowledge(events: DataFrame, provider: str = "provider_name", code: str = "event_code") -> DataFrame:
    """Exact (provider, code) entry, else the first entry without a code whose provider is a substring.

    The dimension is the fixed list above, so broadcasting it is safe at any data size. Which wildcard entry
    applies is decided by a CASE over those entries (one today), so both lookups are equi-joins.
    """
    kb = knowledge_base(events.sparkSession)
    wild = [row[0] for row in KNOWLEDGE if row[1] is None]
    lowered = F.lower(F.coalesce(F.col(provider), F.lit("")))
    exact_keys = [(row[0], row[1]) for row in KNOWLEDGE if row[1] is not None]
    is_exact = F.lit(False)
    for p, c in exact_keys:
        is_exact = is_exact | ((F.col(provider) == p) & (F.col(code) == c))
    wildcard = F.lit(None).cast("string")
    for p in reversed(wild):
        wildcard = F.when(F.contains(lowered, F.lit(p.lower())), p).otherwise(wildcard)
    known = F.coalesce(is_exact, F.lit(False))
    keyed = events.withColumns(
        {
            "__p": F.when(known, F.col(provider)).otherwise(wildcard),
            "__c": F.when(known, F.col(code)).otherwise(F.lit(-1)).cast("int"),
        }
    )
    dim = kb.select(
        F.col("kb_provider").alias("__p"),
        F.coalesce("kb_code", F.lit(-1)).alias("__c"),
        F.col("title").alias("kb_title"),
        F.col("diagnosis").alias("kb_diagnosis"),
        F.col("causes").alias("kb_causes"),
        F.col("solutions").alias("kb_solutions"),
    )
    return keyed.join(F.broadcast(dim), ["__p", "__c"], "left").drop("__p", "__c")


def detect_errors(events: DataFrame, xml: str | None = "raw_xml") -> DataFrame:
    """Events of level 1 to 3 with title, diagnosis, causes and solutions from the knowledge base or keywords."""
    have = set(events.columns)
    rows = events.filter(collected_level(F.col("level")))
    rows = with_description(rows, xml, "__raw_desc") if xml and xml in have else rows.withColumn("__raw_desc", F.lit(None).cast("string"))
    code = "event_code" if "event_code" in have else "event_id"
    rows = rows.withColumns({"provider_name": F.coalesce("provider_name", F.lit("")), "__desc": F.coalesce("__raw_desc", F.lit(""))})
    rows = rows.withColumn("__code", F.coalesce(F.col(code), F.lit(0)))
    rows = with_knowledge(rows, "provider_name", "__code")
    rows = classify_unknown(rows, F.col("provider_name"), F.col("__desc"), F.col("__code"))
    known = F.col("kb_title").isNotNull()

    def given(name: str, default, kind: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default).cast(kind)) if name in have else F.lit(default).cast(kind)

    record = "event_record_id" if "event_record_id" in have else "id"
    no_causes = F.array().cast("array<string>")
    return rows.select(
        F.coalesce(F.col(record), F.lit(0)).alias("event_record_id"),
        "provider_name",
        F.col("__code").alias("event_code"),
        "level",
        level_name(F.col("level")).alias("level_name"),
        (F.col("event_time") if "event_time" in have else F.col("ingested_at")).alias("event_time"),
        given("log_channel", "Unknown", "string").alias("log_channel"),
        given("fault_type", "UNKNOWN", "string").alias("fault_type"),
        F.when(known, "KNOWN").otherwise(F.col("kw_subtype")).alias("fault_subtype"),
        F.when(known, 0.9).otherwise(F.col("kw_confidence")).alias("confidence_score"),
        given("cpu_usage_percent", 0, "double").alias("cpu_at_time"),
        given("memory_usage_percent", 0, "double").alias("memory_at_time"),
        given("disk_free_percent", 0, "double").alias("disk_at_time"),
        known.alias("known"),
        F.coalesce("kb_title", "kw_title").alias("title"),
        F.coalesce("kb_diagnosis", "kw_diagnosis").alias("diagnosis"),
        F.col("__desc").alias("description"),
        F.when(known, F.col("kb_causes")).otherwise(no_causes).alias("causes"),
        F.when(known, F.col("kb_solutions")).otherwise(F.array(F.lit(CHECK_VIEWER))).alias("solutions"),
    )


def diagnostic_context(cpu: Column, memory: Column, disk: Column) -> Column:
    """Struct of the readings and the list of threshold breaches (strict comparisons)."""
    alerts = F.array_compact(
        F.array(
            F.when(cpu > CPU_ALERT, F.concat(F.lit("HIGH CPU: "), cpu.cast("string"), F.lit("%"))),
            F.when(memory > MEMORY_ALERT, F.concat(F.lit("HIGH MEMORY: "), memory.cast("string"), F.lit("%"))),
            F.when(disk < DISK_ALERT, F.concat(F.lit("LOW DISK: "), disk.cast("string"), F.lit("% free"))),
        )
    )
    state = F.struct(cpu.alias("cpu_percent"), memory.alias("memory_percent"), disk.alias("disk_free_percent"))
    return F.struct(state.alias("resource_state"), alerts.alias("resource_alerts"))
