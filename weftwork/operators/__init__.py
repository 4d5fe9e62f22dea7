"""Mapping operators as DataFrame functions: lazy, declarative, no driver-side rows."""
