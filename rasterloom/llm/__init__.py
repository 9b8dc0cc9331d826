"""Training-data operators: search, packing, deduplication, formatting, filtering and mixing.

Nothing outside this subpackage imports it. Each module holds one operator; ``entries`` holds
the registered queries and their SQL.
"""
