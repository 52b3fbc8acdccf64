"""streaming of folioscan."""
