"""Training-data operators; see each module. Nothing outside this subpackage imports it."""
