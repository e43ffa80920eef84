"""Sources, sinks and derived input tables."""
