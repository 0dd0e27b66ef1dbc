"""Writers: replace, append, batched files, CSV, catalog and lake tables, write-once results."""
