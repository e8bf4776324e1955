"""The registered queries: a Spark callable and the SQL that must agree with it.

Each module registers its entries on import. Both sides read the same parquet
tables; the Spark side goes through the library, the SQL states the semantics
directly.
"""
