"""Interfaces to what lies outside an engine: language models, page readers, decoders, downloads.

Each is a function that takes and returns columns of plain values, is given by the caller, and has a deterministic
stand-in. The checks before and after a call are part of the library.
"""
