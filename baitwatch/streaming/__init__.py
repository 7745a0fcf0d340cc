"""Structured Streaming scans."""
