"""Training-data operators: extraction, scoring, deduplication, filtering and packing of text corpora.

Nothing outside this folder imports it; ``corpus_pipeline.py`` and the entry module add its queries.
"""
