"""Training-data operators: deduplication, fingerprints, archives, classifiers, mixing and tokenisation."""
