"""Part of dialectica."""
