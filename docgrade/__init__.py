"""docgrade: document grading and organising as DataFrame plans."""
