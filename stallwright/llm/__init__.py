"""Operators over text and behaviour for training data; nothing outside this subpackage imports it."""
