"""Training-data operators: token counts, dedup, filters, packing, scoring."""
