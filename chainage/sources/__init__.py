"""Readers and writers of the formats around the tables."""
