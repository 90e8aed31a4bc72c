"""Training-data operators: chat formatting, packing, licences, near duplicates, quality, tokens, toxicity, language, URLs."""
