"""Training-data operators: packing, language ID, URL filters, near and exact
deduplication, source mixing, secret scans, exact top-k search, repeated
passages and WARC archives.  Nothing else in the library imports this package.
"""
