"""Training-data pipeline operators (packing, filters, dedup, extraction, scoring).

Nothing outside this package imports it; it may be deleted as a whole.
"""
