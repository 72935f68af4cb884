"""Readers and writers: rosters, sidecar files, documents and caches."""
