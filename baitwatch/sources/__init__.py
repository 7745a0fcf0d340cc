"""Readers, writers and derived inputs."""
