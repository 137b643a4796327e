"""Training-data operators: filters, near-duplicate search, scoring and packing.

Nothing outside this folder imports it; ``queries`` lists its registered queries.
"""
