"""Tables in and out: CSV corpora, feature tables, models, caches, pages, word lists."""
