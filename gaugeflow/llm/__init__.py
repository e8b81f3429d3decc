"""Training-data operators: PII, chat formatting, language ID, top-k search, mixing, toxicity, quality, near-dedup, rules, BPE."""
