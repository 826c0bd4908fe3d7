"""Word lists, patterns, thresholds, message texts and profile tables."""
