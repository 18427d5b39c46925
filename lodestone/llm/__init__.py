"""Training-data operators: packing, search, URL and licence filters, WARC, dedup, quality."""
