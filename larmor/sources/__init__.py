"""Sources: acquisition tables, raw arrays, simulated data, and driver tables standing in for acquisitions."""
