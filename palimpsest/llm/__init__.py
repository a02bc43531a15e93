"""Training-data operators: filters, fingerprints, packing, sharding and mixing of text corpora."""
