"""docq: curation and evaluation of document datasets as Spark jobs."""
