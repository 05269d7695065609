"""Multi-stage jobs."""
