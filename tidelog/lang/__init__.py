"""Stream language: text to syntax trees, checks and hashes (driver only)."""
