"""quillmere: preparation, search and curation of document collections on Spark."""
