"""newsmill: news and science-announcement curation as PySpark DataFrame jobs."""
