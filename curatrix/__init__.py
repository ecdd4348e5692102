"""curatrix: curation of labelled data as Spark DataFrame jobs."""
