"""Readers, keys and the mapping from event streams to diaries."""
