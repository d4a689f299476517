"""Training-data operators: archives, search, tokenizing, scoring, sketches and packing.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
when it can be imported.
"""
