"""tablekeeper: data stewardship as Spark jobs.

Layered tables, profiles, data-quality checks, lineage tracing, root cause
and severity, rule-based repairs applied as table versions, fix history and
a streaming monitor - all as DataFrame operators.  Start with
``tablekeeper.session.get_spark`` for local runs; the operators live in
``tablekeeper.operators``, sources and sinks in ``tablekeeper.sources``,
column expressions in ``tablekeeper.functions`` and streaming jobs in
``tablekeeper.streaming``.
"""

__version__ = "0.1.0"
