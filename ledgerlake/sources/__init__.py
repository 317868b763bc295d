"""Where blocks come from, and configuration."""
