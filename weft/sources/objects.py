"""Object streams: repositories' commits and trees, in one gzip or plain file."""

from __future__ import annotations

import gzip
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.scalar import mode_name
from weft.schemas import COMMITS, OBJECTS, TREE_ENTRIES

# Fixed values of the format.
MAGIC = b"\x30\x9e\xb9\x08"
PACK = b"PACK\x00\x00\x00\x02"
KINDS = {1: "commit", 2: "tree"}


def decode(data: bytes) -> Iterator[tuple[str, str, str, bytes]]:
    """(repo, type, sha, payload) of each object; repositories without a pack are skipped."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if data[:4] != MAGIC:
        raise ValueError("not an object stream")
    at = 4
    while at < len(data):
        if data[at : at + 5] != b"REPO ":
            raise ValueError(f"no repository at byte {at}")
        end = data.index(b"\0", at)
        repo, at = data[at + 5 : end].decode(), end + 1
        if data[at : at + 1] != b"P":
            continue
        if data[at : at + 8] != PACK:
            raise ValueError(f"no pack at byte {at}")
        at += 12
        while True:
            kind, size, at = _header(data, at)
            if kind == 0:
                at += 20
                break
            if kind not in KINDS:
                raise ValueError(f"object type {kind} at byte {at}")
            payload, at = _inflated(data, at, size)
            name = KINDS[kind]
            yield repo, name, hashlib.sha1(f"{name} {size}\0".encode() + payload).hexdigest(), payload


def _inflated(data: bytes, at: int, size: int) -> tuple[bytes, int]:
    """The object of size bytes that begins at a byte, its adler32 sum checked, and where it ends. It is fed in pieces of
    bounded size, so that a file of many objects takes time in proportion to its length."""
    z, parts, view, to = zlib.decompressobj(), [], memoryview(data), at
    while not z.eof and to < len(data):
        piece = view[to : to + min(1 << 16, size + 64)]
        parts.append(z.decompress(piece))
        to += len(piece)
    payload = b"".join(parts) + z.flush()
    if not z.eof or len(payload) != size:
        raise ValueError(f"broken object at byte {at}")
    return payload, to - len(z.unused_data)


def _header(data: bytes, at: int) -> tuple[int, int, int]:
    """Type and size of an object: a low nibble, then groups of seven bits while the top bit is set."""
    b = data[at]
    kind, size, shift, at = b >> 4 & 7, b & 15, 4, at + 1
    while b & 128:
        b = data[at]
        size |= (b & 127) << shift
        shift, at = shift + 7, at + 1
    return kind, size, at


def encode(repos: list[tuple[str, list[tuple[str, bytes]] | None]], compress: bool = True) -> bytes:
    """A stream of repositories, each with its objects or None for a header alone; payloads in stored blocks."""
    out = [MAGIC]
    for repo, objects in repos:
        out.append(b"REPO " + repo.encode() + b"\0")
        if objects is None:
            continue
        out.append(PACK + struct.pack(">I", len(objects)))
        for kind, payload in objects:
            n, head = len(payload), []
            b, n = {v: k for k, v in KINDS.items()}[kind] << 4 | n & 15, n >> 4
            while n:
                head.append(b | 128)
                b, n = n & 127, n >> 7
            out.append(bytes([*head, b]) + zlib.compress(payload, 0))
        out.append(b"\0" + bytes(20))
    body = b"".join(out)
    return gzip.compress(body) if compress else body


def read_objects(spark: SparkSession, *paths: str) -> DataFrame:
    """One row for each object of the files; a file is one task's work, as the format can only be read from its start."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for row in decode(content):
                    rows.append(row)
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=["repo", "type", "sha", "payload"])
                        rows = []
                yield pd.DataFrame(rows, columns=["repo", "type", "sha", "payload"])

    return spark.read.format("binaryFile").load(list(paths)).select("content").mapInPandas(run, OBJECTS)


def commits(objects: DataFrame) -> DataFrame:
    """(repo, sha, tree_sha, parents) of the commits; what follows the parents in a commit is not read."""
    text = F.decode("payload", "ISO-8859-1")
    head = F.regexp_extract(text, r"(?s)\A(tree [0-9a-f]{40}\n(?:parent [0-9a-f]{40}\n)*)", 1)
    return objects.where("type = 'commit'").select("repo", "sha", F.substring(head, 6, 40).alias("tree_sha"), F.regexp_extract_all(head, F.lit(r"parent ([0-9a-f]{40})\n"), 1).alias("parents")).to(_schema(COMMITS))


def tree_entries(objects: DataFrame) -> DataFrame:
    """(repo, tree_sha, name, mode, sha) of the trees' entries."""

    def run(batches):
        for pdf in batches:
            rows = []
            for repo, sha, payload in zip(pdf["repo"], pdf["sha"], pdf["payload"], strict=True):
                at = 0
                while at < len(payload):
                    blank, zero = payload.index(b" ", at), payload.index(b"\0", at)
                    rows.append((repo, sha, payload[blank + 1 : zero].decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode(), payload[at:blank].decode(), payload[zero + 1 : zero + 21].hex()))
                    at = zero + 21
            yield pd.DataFrame(rows, columns=["repo", "tree_sha", "name", "mode", "sha"])

    raw = objects.where("type = 'tree'").select("repo", "sha", "payload").mapInPandas(run, TREE_ENTRIES)
    return raw.withColumn("mode", mode_name(F.col("mode")))


def selected(objects: DataFrame, jobs: DataFrame) -> DataFrame:
    """Objects of the repositories that the job names."""
    return objects.join(jobs.where("kind = 'repo'").select(F.col("value").alias("repo")), "repo", "left_semi")


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
