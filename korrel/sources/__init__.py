"""Package of sources."""
