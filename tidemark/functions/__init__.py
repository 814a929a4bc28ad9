"""Column expressions.  Nothing here runs a job."""
