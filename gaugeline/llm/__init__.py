"""Operators for building training corpora: one module per operator, shared helpers in ``words``,
``pieces``, ``chunks`` and ``links``.  Nothing outside this subpackage imports it."""
