"""Corpus operators: near-dedup, secret scans, nearest neighbours, tokenisation, packing, quality rules, chat, WARC."""
