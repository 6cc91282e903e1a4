"""xsdframe: XML documents as typed, queryable Spark columns.

Schema files are compiled on the driver into a plan (a ``StructType`` plus
Catalyst column builders); row functions built from that plan are stateless,
so they run unchanged on batch and streaming DataFrames.
"""

__version__ = "0.1.0"
