"""JSON Schema: loading, digest, validation of rows, and findings in plain words."""
