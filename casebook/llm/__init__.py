"""Training-data operators: ten self-contained steps for large text corpora.

Nothing outside this folder imports it; ``queries.py`` lists what can be run.
"""
