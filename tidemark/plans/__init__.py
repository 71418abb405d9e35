"""Multi-stage jobs and the registry of checked queries."""
