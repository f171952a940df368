"""Graph files: packed graphs in LZ4 blocks, for exchange; Parquet is the native store."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.hashing import xxh64
from weft.schemas import GRAPHS

# Fixed value of the format.
MAGIC = b"^<k\x85"


def lz4_decode(block: bytes, size: int) -> bytes:
    """An LZ4 block: runs of literals, each but the last followed by a copy from what is already there."""
    out, at = bytearray(), 0

    def length(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                more = block[at]
                at += 1
                n += more
                if more < 255:
                    break
        return n

    while at < len(block):
        token = block[at]
        at += 1
        n = length(token >> 4)
        out += block[at : at + n]
        at += n
        if at >= len(block):
            break
        back = block[at] | block[at + 1] << 8
        at += 2
        n = length(token & 15) + 4
        if not 0 < back <= len(out):
            raise ValueError("broken block")
        for i in range(0, n, back):
            start = len(out) - back
            out += out[start : start + min(back, n - i)]
    if len(out) != size:
        raise ValueError("broken block")
    return bytes(out)


def lz4_encode(data: bytes) -> bytes:
    """A valid LZ4 block of literals alone."""
    n = len(data)
    head = bytearray([min(n, 15) << 4])
    if n >= 15:
        head += b"\xff" * ((n - 15) // 255) + bytes([(n - 15) % 255])
    return bytes(head) + data


def encode_graph(name: str, offsets: list[int], adj: list[tuple[int, int]]) -> bytes:
    """The uncompressed block: three offsets from their own places to name, nodes and edges, each with its count."""
    text = name.encode() + b"\0"
    parts = [struct.pack("<I", len(text)) + text, struct.pack("<I", len(offsets)) + np.asarray(offsets, "<u4").tobytes(), struct.pack("<I", len(adj)) + np.asarray(adj, "<u4").reshape(-1, 2).tobytes()]
    starts = [12, 12 + len(parts[0]), 12 + len(parts[0]) + len(parts[1])]
    return struct.pack("<3I", *(s - 4 * i for i, s in enumerate(starts))) + b"".join(parts)


def decode_graph(block: bytes) -> tuple[str, list[int], list[tuple[int, int]]]:
    a, b, c = (4 * i + x for i, x in enumerate(struct.unpack_from("<3I", block)))
    n = struct.unpack_from("<I", block, a)[0]
    name = block[a + 4 : a + 4 + n].split(b"\0")[0].decode()
    n = struct.unpack_from("<I", block, b)[0]
    offsets = np.frombuffer(block, "<u4", n, b + 4).tolist()
    n = struct.unpack_from("<I", block, c)[0]
    return name, offsets, [tuple(x) for x in np.frombuffer(block, "<u4", 2 * n, c + 4).reshape(-1, 2).tolist()]


def encode_file(graphs: list[tuple[str, list[int], list[tuple[int, int]]]]) -> bytes:
    out = [MAGIC]
    for g in graphs:
        block = encode_graph(*g)
        packed = lz4_encode(block)
        out += [struct.pack("<2I", len(block), len(packed)), packed]
    return b"".join(out)


def decode_file(data: bytes):
    """(index, name, offsets, adj, sizes, checksum) of each graph; the checksum is that of the uncompressed block."""
    if data[:4] != MAGIC:
        raise ValueError("not a graph file")
    at, index = 4, 0
    while at < len(data):
        size, packed = struct.unpack_from("<2I", data, at)
        if at + 8 + packed > len(data):
            raise ValueError("cut off")
        block = lz4_decode(data[at + 8 : at + 8 + packed], size)
        yield (index, *decode_graph(block), size, packed, f"{xxh64(block):016x}")
        at, index = at + 8 + packed, index + 1


def read_graphs(spark: SparkSession, *paths: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                for i, name, offsets, adj, size, packed, checksum in decode_file(content):
                    yield pd.DataFrame({"graph_index": [i], "name": [name], "offsets": [offsets], "adj": [[{"other": o, "weight": w} for o, w in adj]], "byte_size": [size], "byte_size_compressed": [packed], "checksum": [checksum]})

    return spark.read.format("binaryFile").load(list(paths)).select("content").mapInPandas(run, GRAPHS)


def write_graphs(packed: DataFrame, path: str) -> None:
    """Packed rows (repo, offsets, adj) as blocks in Parquet (graph, block), from which concat_file() makes one file."""

    def run(batches):
        for pdf in batches:
            for name, offsets, adj in zip(pdf["repo"], pdf["offsets"], pdf["adj"], strict=True):
                block = encode_graph(name, list(offsets), [(a["other"], a["weight"]) for a in adj])
                body = lz4_encode(block)
                yield pd.DataFrame({"graph": [name], "block": [struct.pack("<2I", len(block), len(body)) + body]})

    packed.select("repo", "offsets", "adj").mapInPandas(run, "graph string, block binary").write.mode("overwrite").parquet(path)


def concat_file(spark: SparkSession, path: str, target: str) -> None:
    """One exchange file of the blocks in the order of names, written piece by piece."""
    with open(target, "wb") as f:
        f.write(MAGIC)
        for r in spark.read.parquet(path).orderBy(F.col("graph")).toLocalIterator():
            f.write(r.block)
