"""Training-data operators (n-gram joins, classifiers, tokenizers, dedup, decontamination)."""
