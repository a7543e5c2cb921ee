"""Scans and sinks."""

from litscore.sources.digests import write_digest
from litscore.sources.dumps import SOURCE_KINDS, read_source_dump
from litscore.sources.library import read_library, read_library_csv, write_library
from litscore.sources.messages import read_messages

__all__ = [
    "SOURCE_KINDS",
    "read_library",
    "read_library_csv",
    "read_messages",
    "read_source_dump",
    "write_digest",
    "write_library",
]
