"""Training-data operators: filters, classifier, tokens, packing, sharding, nearest neighbours and deduplication."""
