"""Step flows, verdict roll-ups, change detection."""
