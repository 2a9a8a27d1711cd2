"""Readers, writers, calendars and the mapping from the test tables to workforce tables."""
