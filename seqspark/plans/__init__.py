"""Plan helpers: session, scratch tables and size-checked broadcasts."""
