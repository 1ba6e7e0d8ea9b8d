"""Training-data operators: near duplicates, quality, secrets, language models, tokens, mixing, shards, media.

Nothing else in the library imports this subpackage.
"""
