"""gridloom: a PySpark-native engine for dense minute metrics of exchange tick records.

Subpackages: ``functions`` (Column builders), ``sources`` (scans and sinks), ``operators`` (DataFrame
operators), ``plans`` (run control), ``streaming`` (incremental pipelines), ``queries`` (registered queries).
"""

__version__ = "0.1.0"
