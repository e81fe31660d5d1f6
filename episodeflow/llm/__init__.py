"""Training-data operators: archives, secrets, chat templates, toxicity,
tokenisation, near duplicates, decontamination, repeated text, URL filters and
vector search.

Nothing outside this subpackage imports it.
"""
