"""Training-data operators: quality, rules, packing, chat, URL, dedup, decontamination, token files, toxicity.

Nothing outside this subpackage imports it; ``queries`` holds the thin queries.
"""
