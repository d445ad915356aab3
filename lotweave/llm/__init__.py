"""Operators that prepare texts and records for training; nothing outside this subpackage imports it."""
