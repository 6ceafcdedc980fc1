"""Readers for single archive files, used inside tasks."""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime
from functools import cached_property
from typing import BinaryIO, NamedTuple

import pandas as pd
from pyarrow import fs as pafs

from voltrail.session import send_to_tasks

send_to_tasks(__name__)

CHUNK_BYTES = 4 * 1024 * 1024

# Compression method codes of ZIP members.
ZIP_METHODS = {0: "stored", 8: "deflate", 9: "deflate64", 12: "bzip2", 14: "lzma", 93: "zstd", 95: "xz"}

_LOCAL_HEADER = "<4s5H3I2H"
_ENCRYPTED = 0x1


class BadContent(Exception):
    """A member whose bytes cannot be unpacked."""


class Member(NamedTuple):
    member_no: int
    filename: str
    compressed: int
    uncompressed: int
    is_directory: bool
    modified: datetime | None
    crc32: int | None
    method: str
    offset: int


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a Spark path (`file:/x`, `hdfs://..`, `s3a://..`, `/x`)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))


def stat(uri: str) -> tuple[datetime, int]:
    """When a file was changed, and its size."""
    files, path = filesystem(uri)
    info = files.get_file_info(path)
    return info.mtime, info.size


class ReadAhead(io.BufferedReader):
    """A seekable file, read ahead in chunks."""

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return super().seek(offset, whence)
        except ValueError as before_start:
            raise OSError(str(before_start)) from before_start


def open_path(uri: str) -> BinaryIO:
    files, path = filesystem(uri)
    return ReadAhead(files.open_input_file(path), CHUNK_BYTES)


def _inflate(pieces: Iterator[bytes]) -> Iterator[bytes]:
    unpacker = zlib.decompressobj(-zlib.MAX_WBITS)
    for piece in pieces:
        while piece:
            yield unpacker.decompress(piece, CHUNK_BYTES)
            piece = unpacker.unconsumed_tail
    yield unpacker.flush()


def _bunzip(pieces: Iterator[bytes]) -> Iterator[bytes]:
    unpacker = bz2.BZ2Decompressor()

    def unpack(piece: bytes) -> bytes:
        try:
            return unpacker.decompress(piece, CHUNK_BYTES)
        except OSError as broken:
            raise BadContent(str(broken)) from broken

    for piece in pieces:
        yield unpack(piece)
        while not unpacker.needs_input and not unpacker.eof:
            yield unpack(b"")


_UNPACKERS = {"stored": iter, "deflate": _inflate, "bzip2": _bunzip}


class ZipReader:
    """Lists members from the archive's directory; reads a member at its offset without it."""

    def __init__(self, source: BinaryIO) -> None:
        self.source = source

    @cached_property
    def archive(self) -> zipfile.ZipFile:
        return zipfile.ZipFile(self.source)

    def members(self) -> Iterator[Member]:
        for no, info in enumerate(self.archive.infolist()):
            yield Member(
                no, info.filename, info.compress_size, info.file_size, info.is_dir(), _instant(info.date_time),
                info.CRC, ZIP_METHODS.get(info.compress_type, str(info.compress_type)), info.header_offset,
            )

    def _packed(self, member: Member) -> Iterator[bytes]:
        self.source.seek(member.offset)
        header = struct.unpack(_LOCAL_HEADER, self.source.read(struct.calcsize(_LOCAL_HEADER)))
        if header[2] & _ENCRYPTED:
            raise BadContent("the member is encrypted")
        self.source.seek(header[9] + header[10], 1)
        left = member.compressed
        while left > 0 and (piece := self.source.read(min(left, CHUNK_BYTES))):
            left -= len(piece)
            yield piece

    def content(self, member: Member) -> Iterator[bytes]:
        """The unpacked bytes in pieces, checksum not looked at."""
        if member.method not in _UNPACKERS:
            with self.archive.open(self.archive.infolist()[member.member_no]) as opened:
                while piece := opened.read(CHUNK_BYTES):
                    yield piece
            return
        pieces = _UNPACKERS[member.method](self._packed(member))
        while True:
            try:
                piece = next(pieces, None)
            except (zlib.error, EOFError, ValueError) as broken:
                raise BadContent(str(broken)) from broken
            if piece is None:
                return
            yield piece


def _instant(parts: tuple[int, ...]) -> datetime | None:
    """Member times may be unset or nonsense; the content is still good."""
    try:
        return datetime(*parts)
    except ValueError:
        return None


def actual_crc(reader: ZipReader, member: Member) -> int | None:
    """CRC of the unpacked bytes; None if they cannot be unpacked."""
    crc = 0
    try:
        for piece in reader.content(member):
            crc = zlib.crc32(piece, crc)
    except (BadContent, zipfile.BadZipFile, lzma.LZMAError, EOFError):
        return None
    return crc


def checked_chunks(reader: ZipReader, member: Member) -> Iterator[bytes]:
    """The content in chunks of `CHUNK_BYTES`; fails at the end if the checksum is not the member's."""
    crc, held = 0, bytearray()
    for piece in reader.content(member):
        crc = zlib.crc32(piece, crc)
        held += piece
        while len(held) >= CHUNK_BYTES:
            yield bytes(held[:CHUNK_BYTES])
            del held[:CHUNK_BYTES]
    if held:
        yield bytes(held)
    if not pd.isna(member.crc32) and crc != member.crc32:
        raise BadContent(f"bad checksum of {member.filename}")


# Leading bytes -> reader. The content decides, not the file's suffix.
READERS = {
    b"PK\x03\x04": ZipReader,
    b"PK\x05\x06": ZipReader,
}


def open_archive(uri: str) -> ZipReader:
    source = open_path(uri)
    head = source.read(6)
    source.seek(0)
    for magic, reader in READERS.items():
        if head.startswith(magic):
            return reader(source)
    raise ValueError(f"not a known archive: {uri}")
