"""Training-data operators: deduplication, decontamination, scoring, redaction and packing."""
