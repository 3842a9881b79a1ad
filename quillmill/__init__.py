"""quillmill: a PySpark engine that archives, searches and audits conversation and document data."""
