"""rolefit: resume and job-posting matching over whole corpora, as PySpark DataFrame jobs."""
