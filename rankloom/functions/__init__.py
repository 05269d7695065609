"""Column expressions; nothing here triggers a job."""
