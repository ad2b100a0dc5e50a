"""Part of the vellum engine."""
