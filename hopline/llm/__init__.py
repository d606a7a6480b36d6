"""Training-data operators: sharding, deduplication, filtering, packing and token files.

Nothing outside this folder imports it.  ``hopline.llm.entries`` lists its queries.
"""
