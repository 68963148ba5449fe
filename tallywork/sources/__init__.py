"""Readers that return (accepted, refusals), and writers."""
