"""Graphs that grow: folders of N-Triples, or streaming tables through a template, added batch by batch."""

from .ingest import stream_ntriples, stream_template

__all__ = ["stream_ntriples", "stream_template"]
