"""Training-data operators: packing, filtering, dedup, mixing, search, sharding.

Each module holds one operator with its own general interface; ``queries``
holds the thin registered queries and ``oracles`` their DuckDB twins.
Nothing outside this subpackage imports it.
"""
