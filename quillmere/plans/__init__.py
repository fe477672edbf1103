"""Plan helpers: sessions, lineage cuts and partition sizing."""
