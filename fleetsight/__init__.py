"""Fleet telemetry analytics as Spark DataFrame operators.

Sub-packages: ``sources`` (readers, sinks, table adapter), ``functions`` (column expressions),
``operators`` (DataFrame -> DataFrame), ``streaming`` (Structured Streaming jobs) and ``plans``
(the named queries with their SQL oracles).
"""

__version__ = "0.1.0"
