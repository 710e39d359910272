"""Plan helpers: intermediate tables that outlive a lost executor."""
