"""parley: document-to-dialogue-to-audio pipelines as Spark DataFrame operators.

Subpackages: ``functions`` (column expressions and fixed values),
``operators`` (DataFrame -> DataFrame operators), ``sources`` / ``sinks``,
``streaming`` (Structured Streaming forms), ``plans`` (registered queries
with their DuckDB oracles and the end-to-end flows).
"""

__version__ = "0.1.0"
