"""Explicit schemas of the graph tables; nothing relies on inference."""

OBJECTS = "repo string, type string, sha string, payload binary"
COMMITS = "repo string, sha string, tree_sha string, parents array<string>"
TREE_ENTRIES = "repo string, tree_sha string, name string, mode string, sha string"
CHANGED = "repo string, commit string, path string"
EDGES = "repo string, lo long, hi long, weight long"
GRAPHS = "graph_index int, name string, offsets array<int>, adj array<struct<other:int,weight:int>>, byte_size int, byte_size_compressed int, checksum string"
INSTANCES = "instance_id long, repo string, kind string, x array<float>, y float"
PARAMS = "name string, shape array<int>, values array<float>"

# Kinds of tree entries by octal mode. Anything else is a plain file.
MODES = {0o40000: "DIR", 0o100644: "BLOB", 0o100664: "BLOB_GROUP", 0o100755: "BLOB_EXE", 0o100777: "BLOB_EXE", 0o120000: "SYMLINK", 0o160000: "GITLINK"}
