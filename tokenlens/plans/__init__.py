"""Plan-level choices and compositions (broadcast guards, search strategy, end-to-end plans)."""
