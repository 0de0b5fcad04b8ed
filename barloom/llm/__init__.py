"""Training-data operators: sharding, decontamination, quality, secrets, licences, PII, deduplication, packing, pages."""
