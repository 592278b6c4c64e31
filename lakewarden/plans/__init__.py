"""Report plans over the registry, run, queue and job tables."""
