"""Plan helpers: tables in the shared folder, per-session settings, query registry."""
