"""Readers: text exports, archives, the stored tables, event and URL lists."""
