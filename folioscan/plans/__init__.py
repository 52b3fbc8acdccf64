"""plans of folioscan."""
