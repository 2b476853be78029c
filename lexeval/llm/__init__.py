"""Training-data operators: quality rules, line dedup, sharding, archive
conversion, packing, decontamination, URL filters, language ID, near-duplicate
detection and toxicity scoring.  Nothing else in the package imports this
subpackage; ``__spark_entry__`` registers its queries when it is present."""
