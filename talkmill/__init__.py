"""Analytics over conversation and document corpora, as Spark jobs."""
