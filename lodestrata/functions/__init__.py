"""lodestrata subpackage."""
