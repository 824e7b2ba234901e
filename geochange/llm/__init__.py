"""Training-data operators: quality, toxicity, language, duplicates, mixing, tokens, chat.

Nothing outside this folder imports it; the entry module adds its queries when it is there.
"""
