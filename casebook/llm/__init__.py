"""Training-data operators: licence scan, near and exact deduplication,
top-k search, chat formatting, tokenising, secret scan, language id, main-text
extraction and benchmark decontamination.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own interface; ``queries`` holds the registered jobs.
"""
