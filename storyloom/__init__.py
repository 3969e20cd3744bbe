"""storyloom: story-feed curation and search as Spark DataFrame jobs."""
