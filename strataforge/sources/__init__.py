"""Readers of pages: crawls, archives, files, link lists."""
