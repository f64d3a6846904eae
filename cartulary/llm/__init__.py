"""Training-data operators. Nothing outside this subpackage imports it, save the guarded import of the entry point."""
