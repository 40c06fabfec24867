"""Readers and writers: flow files, registry, geometry, archives and the flow mart."""
