"""Landed inputs, stored tables and result sinks."""
