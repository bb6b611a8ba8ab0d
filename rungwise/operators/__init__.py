"""Table operators: every operator takes and returns ``DataFrame``."""
