"""Reports of a run."""
