"""korvane: text search, crawl bookkeeping and corpus analytics as Spark plans."""
