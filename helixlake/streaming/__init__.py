"""Empty on purpose: the workload is batch only (its windows are positional, not in time)."""
