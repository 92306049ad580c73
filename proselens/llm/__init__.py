"""Training-data operators: language models, quality, language, near copies,
sharding, URL rules, decontamination, personal data, toxicity, mixing, exact
copies, ranked search and vector codes.

Nothing outside this folder imports it.
"""
