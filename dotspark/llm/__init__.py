"""Training-data operators: tokens, language, toxicity, dedup, media, mixing, BPE, chat, LM scores."""
