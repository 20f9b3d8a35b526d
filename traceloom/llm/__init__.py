"""Operators for training texts; nothing outside this subpackage imports it."""
