"""Query catalogue and the end-to-end ranking flow."""
