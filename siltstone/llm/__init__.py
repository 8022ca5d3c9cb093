"""Operations of a training-data pipeline: formatting, scans, deduplication, quality, mixing, packing, search.

Nothing outside this subpackage imports it; ``siltstone.llm.queries`` lists its queries and SQL.
"""
