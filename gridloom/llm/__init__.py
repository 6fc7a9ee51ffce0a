"""Training-data operators: packing, token counts, classifiers, decontamination, filters, dedup.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
