"""sources of folioscan."""
