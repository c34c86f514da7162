"""Training-data operators: packing, quality, similarity joins, decontamination and scans.

Nothing outside this subpackage imports it; ``tidewell.llm.registry`` lists its queries.
"""
