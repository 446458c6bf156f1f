"""Structured Streaming forms of four operators, for a record that grows by appended visits."""
