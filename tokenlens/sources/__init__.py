"""Sources and sinks: token shard files, the corpus table, vocabularies, fact tables."""
