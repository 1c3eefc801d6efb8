"""Training-data operators: packing, quality, sharding, decontamination, extraction, dedup, language model, WARC, whitening, conversations."""
