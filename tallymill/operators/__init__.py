"""DataFrame-to-DataFrame jobs: filter, route, parse, deduplicate, pair, review, report."""
