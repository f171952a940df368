"""N-gram Jaccard join by a token-group matrix.

Similar documents are put into groups; the matrix holds each group's token union; a query is a document, and a group
opens for it only if the query's overlap with the group's union reaches what the threshold asks for. What remains after
that is verified pair by pair, so no link between different sets is lost.

The steps: 1. Words of k become 64-bit tokens. 2. Tokens that no second document has cannot link anything: tokens travel
once, packed in blobs by hash bucket, and only shared ones come back, packed by document. Tokens of a large share of all
documents ("hot") are known beforehand and stay with their documents. 3. Equal sets collapse into one. 4. By the prefix
rule with tokens in order of rareness, two similar sets share one of their rarest tokens; the document of each
such token whose tokens are the commonest is its centre, each document is verified against the centre it meets most, and the components of these links
are the groups. 5. The prefix is long enough to hold several of the rarest tokens that two similar sets have in common.
The matrix has the union of each group's prefixes; a query's overlap with it, on its own prefix, must reach that number,
or the group stays closed. Of an opened group the documents that meet the query as often are verified.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .components import components
from .store import ROW, numbered, scratch, small_batches, without_ids, written

#: Bytes of text for each bucket of tokens and each group of documents.
PER_BUCKET = 2 << 20
#: Bytes of text in each block: the larger, the fewer blobs.
BLOCK = 2 << 20
#: Bits of a token beside those of its bucket.
REST_BITS = 40
#: A block of texts tells of a token that HOT_SHARE of its documents have, HOT_LEAST at least; it is hot if HOT_TOTAL documents
#: are told of, and one in HOT_ONE_IN of all.
HOT_SHARE, HOT_LEAST, HOT_TOTAL, HOT_ONE_IN = 0.005, 4, 500, 5000


def shingles(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each document, in order of documents: hashes and documents. Fewer than k words make one token."""
    low = K.LOWER[raw]
    starts, ends = K.runs(~K.SPACE[low], off)
    first, doc = K.doc_of(starts, off)
    h = K.hash_slices(low, starts, ends)
    keys, at = K.windows(h, doc, k)
    owner = doc[at]
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = n[short].astype(K.U)
        for j in range(k - 1):
            has = n[short] > j
            whole[has] = K.mix(whole[has] + h[first[short[has]] + j] * K.U(3))
        keys = np.concatenate([keys, whole])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
    salt = K.mix(np.arange(1, len(off), dtype=K.U))
    _, later = K.repeated(keys ^ salt[owner])
    return keys[~later], owner[~later]


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # at is the row's number for good, row one for these plans, consecutive within a batch
    row = F.monotonically_increasing_id()
    return docs.select(row.alias("row"), (F.col(ROW) if ROW in docs.columns else row).alias("at"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def hot_tokens(texts: DataFrame, k: int, n_docs: int) -> np.ndarray:
    """Sorted tokens that a large share of documents has: at most HOT_ONE_IN times the mean tokens of a document, however
    many documents and groups of copies there are."""

    def run(batches):
        for _, raw, off in K.blocks(batches, limit=BLOCK):
            keys, _ = shingles(raw, off, k)
            some = np.sort(keys[K.clashing(keys)]) if len(keys) else keys
            edge = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]])) if len(some) else np.zeros(0, dtype=np.int64)
            n = np.diff(np.append(edge, len(some)))
            keep = n >= max(HOT_LEAST, HOT_SHARE * (len(off) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(some[edge][keep].view(np.int64)), pa.array(n[keep])], names=["token", "n"])

    counts = texts.select("row", "text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= max(HOT_TOTAL, n_docs / HOT_ONE_IN)).select("token").toPandas()["token"].to_numpy(dtype=np.int64)
    return np.sort(found.view(K.U))


def _split(keys: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts by part, the parts there are, and their edges in that order."""
    order = np.argsort(keys.astype(np.uint16 if n_parts <= 65536 else np.int64), kind="stable")
    parts, edge = np.unique(keys[order], return_index=True)
    return order, parts, np.append(edge, len(keys))


def _five(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _unfive(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


BLOB = "part long, base long, who binary, a binary, b binary"
_BLOB_NAMES = ["part", "base", "who", "a", "b"]


def _blob_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=_BLOB_NAMES)


META = np.dtype([("row", "<i8"), ("at", "<i8"), ("doc", "<i8"), ("null", "?"), ("size", "<i8"), ("s1", "<u8"), ("s2", "<u8"), ("hot", "<i8")])


def outgoing(texts: DataFrame, k: int, bits: int, hot: np.ndarray) -> DataFrame:
    """Blobs of the tokens by bucket (part >= 0), and of the documents' facts and hot tokens by document group (part < 0)."""
    groups = 1 << bits
    held = texts.sparkSession.sparkContext.broadcast(hot)  # bounded, see hot_tokens()

    def run(batches):
        hot = held.value
        for batch, raw, off in K.blocks(batches, limit=BLOCK):
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            keys, owner = shingles(raw, off, k)
            known = _in(hot, keys)
            n_docs = len(off) - 1
            facts = np.zeros(n_docs, dtype=META)
            facts["at"] = batch.column(1).to_numpy(zero_copy_only=False)
            ids = batch.column(2)
            facts["row"], facts["doc"], facts["null"] = rows, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            facts["size"], facts["hot"] = np.bincount(owner, minlength=n_docs), np.bincount(owner[known], minlength=n_docs)
            edge = np.concatenate([[0], np.cumsum(facts["size"])])
            for name, seed in (("s1", 1), ("s2", 2)):
                to = np.concatenate([np.zeros(1, dtype=K.U), np.cumsum(K.mix(keys + K.U(seed)), dtype=K.U)])
                facts[name] = to[edge[1:]] - to[edge[:-1]]
            out = []
            mine = (K.mix(rows.astype(K.U)) % K.U(groups)).astype(np.int64)
            order, parts, at = _split(mine, groups)
            hot_edge = np.concatenate([[0], np.cumsum(facts["hot"])])
            hot_keys = keys[known]
            for p, a, b in zip(parts, at[:-1], at[1:], strict=True):
                who = order[a:b]
                out.append((-1 - int(p), 0, b"", facts[who].tobytes(), hot_keys[K.ragged(hot_edge[who], facts["hot"][who])].tobytes()))
            # rows of one batch are consecutive, so a document is its distance from the first
            keys, owner = keys[~known], owner[~known]
            bucket = (keys >> K.U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
            rest = keys << K.U(bits) >> K.U(64 - REST_BITS)
            order, parts, at = _split(bucket, groups)
            bucket_rest, bucket_owner = _five(rest[order]), owner[order]
            for p, a, b in zip(parts, at[:-1], at[1:], strict=True):
                out.append((int(p), int(rows[0]), np.diff(bucket_owner[a:b], prepend=0).astype("<u2" if n_docs < 65536 else "<u4").tobytes(), bucket_rest[a:b].tobytes(), b""))
            yield _blob_batch(out)

    return texts.mapInArrow(run, BLOB)


def shared_only(blobs: DataFrame, bits: int) -> DataFrame:
    """Of each bucket the tokens that two documents have at least, as blobs by document group; other blobs pass."""
    groups = 1 << bits

    def run(table: pa.Table) -> pa.Table:
        part = table.column(0)[0].as_py()
        if part < 0:
            return table
        tokens, rows = [], []
        for base, who, a in zip(table.column(1).to_pylist(), table.column(2).to_pylist(), table.column(3).to_pylist(), strict=True):
            rest = _unfive(a)
            tokens.append(rest)
            rows.append(base + np.cumsum(np.frombuffer(who, dtype="<u2" if len(who) == 2 * len(rest) else "<u4").astype(np.int64)))
        tokens, rows = np.concatenate(tokens), np.concatenate(rows)
        some = K.clashing(tokens << K.U(64 - REST_BITS))
        tokens, rows = tokens[some], rows[some]
        order = np.argsort(tokens, kind="stable")
        tokens, rows = tokens[order], rows[order]
        edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, dtype=np.int64)
        df = np.diff(np.append(edge, len(tokens)))
        df = np.repeat(df, df)
        keep = df > 1
        tokens, rows, df = tokens[keep] | K.U(part << REST_BITS), rows[keep], np.minimum(df[keep], 65535).astype("<u2")
        order, parts, at = _split((K.mix(rows.astype(K.U)) % K.U(groups)).astype(np.int64), groups)
        tokens, rows, df = tokens[order], rows[order], df[order]
        out = [(-1 - int(p), 1, rows[a:b].tobytes(), tokens[a:b].tobytes(), df[a:b].tobytes()) for p, a, b in zip(parts, at[:-1], at[1:], strict=True)]
        return pa.Table.from_batches([_blob_batch(out)])

    return blobs.groupBy("part").applyInArrow(K.trimmed(run), BLOB)


def need(size: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that a set of this size needs at least with any similar set."""
    return -(-size * percent // 100)


def extra(needed: np.ndarray) -> np.ndarray:
    """Tokens that the prefix has beyond the one that the prefix rule asks for, and that one: a tenth of the overlap needed."""
    return np.maximum(1, -(-needed // 10))


def _rest(size: str, percent: int) -> str:
    """SQL: how many of a set's shared tokens are not in its prefix."""
    needed = f"(({size} * {percent} + 99) div 100)"
    return f"({needed} - greatest(1, ({needed} + 9) div 10))"


def least_meetings(a: str, b: str, percent: int) -> str:
    """SQL: how many tokens two similar sets of these sizes have in both prefixes at least.

    Their overlap is percent / (100 + percent) of both sizes; of the set whose prefix ends earlier, only the rest can
    hold common tokens that are not in both prefixes.
    """
    overlap = f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"
    return f"greatest(1, {overlap} - greatest({_rest(a, percent)}, {_rest(b, percent)}))"


SETS = "row long, at long, doc_id long, size long, s1 long, s2 long, tokens binary, prefix array<long>, fame long"


def sets(blobs: DataFrame, percent: int) -> DataFrame:
    """One row for each document: its facts, and where its shared tokens suffice for a link, these (sorted) and the rarest of them."""

    def run(table: pa.Table) -> pa.Table:
        facts, hot, rows, tokens, df = [], [], [], [], []
        for kind, who, a, b in zip(*(table.column(i).to_pylist() for i in range(1, 5)), strict=True):
            if kind == 0:
                facts.append(np.frombuffer(a, dtype=META))
                hot.append(np.frombuffer(b, dtype="<u8"))
            else:
                rows.append(np.frombuffer(who, dtype="<i8"))
                tokens.append(np.frombuffer(a, dtype="<u8"))
                df.append(np.frombuffer(b, dtype="<u2"))
        facts, hot = np.concatenate(facts), np.concatenate(hot)
        rows = np.concatenate([*rows, np.repeat(facts["row"], facts["hot"])])
        # hot tokens are the least rare; their top bit is set to keep them apart from the others, which are shorter
        tokens = np.concatenate([*tokens, hot | K.U(1 << 63)])
        df = np.concatenate([*df, np.full(len(hot), 65535, dtype="<u2")])
        by_row = np.argsort(facts["row"])
        facts = facts[by_row]
        at = np.searchsorted(facts["row"], rows)
        n = np.bincount(at, minlength=len(facts))
        least = need(facts["size"], percent)
        able = (facts["size"] > 0) & (n >= least)
        more = extra(least)
        keep = able[at]
        at, tokens, df = at[keep], tokens[keep], df[keep]
        order = np.lexsort((tokens, df, at))
        at, tokens = at[order], tokens[order]
        first = np.searchsorted(at, np.arange(len(facts) + 1))
        # how common a document's tokens are: the text that others were made from ranks above them
        fame = np.bincount(at, weights=df.astype(np.float64)[order], minlength=len(facts)) * 1000 / np.maximum(facts["size"], 1)
        body, prefix = [], []
        for i in range(len(facts)):
            mine = tokens[first[i] : first[i + 1]]
            body.append(np.sort(mine).tobytes() if able[i] else None)
            prefix.append(mine[: len(mine) - least[i] + more[i]].view(np.int64) if able[i] else None)
        doc = pa.array(facts["doc"], mask=facts["null"])
        return pa.Table.from_arrays([pa.array(facts["row"]), pa.array(facts["at"]), doc, pa.array(facts["size"]), pa.array(facts["s1"].view(np.int64)), pa.array(facts["s2"].view(np.int64)), pa.array(body, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(fame.astype(np.int64))], names=["row", "at", "doc_id", "size", "s1", "s2", "tokens", "prefix", "fame"])

    return blobs.where("part < 0").groupBy("part").applyInArrow(K.trimmed(run), SETS)


#: Bitmaps, of 64 hash buckets each, of the tokens that a set lacks of its hub's.
LACKS = ["lack0", "lack1", "lack2", "lack3"]


def overlaps(pairs: DataFrame, able: DataFrame) -> DataFrame:
    """Of pairs (a, b, ...) of rows: their sizes, how many tokens they share, how many b has to share at all, and which
    LACKS of b's tokens a lacks, as (a, b, n_a, n_b, ..., n, all_b, lack0, lack1, ...)."""
    more = [c for c in pairs.columns if c not in ("a", "b")]
    side = lambda c: able.select(F.col("row").alias(c), F.col("size").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("t_a", "t_b", "a", "b", "n_a", "n_b", *more)

    def run(batches):
        for batch in batches:
            n, size, lack = [], [], np.zeros((len(LACKS), batch.num_rows), dtype=K.U)
            for i, (x, y) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                gone = K.mix(y[~_in(x, y)]) % K.U(64 * len(LACKS))
                np.bitwise_or.at(lack[:, i], (gone >> K.U(6)).astype(np.int64), K.U(1) << (gone & K.U(63)))
                size.append(len(y))
                n.append(len(y) - len(gone))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(n, pa.int64()), pa.array(size, pa.int64()), *(pa.array(x.view(np.int64)) for x in lack)], names=[*batch.schema.names[2:], "n", "all_b", *LACKS])

    return both.mapInArrow(run, ", ".join(["a long, b long, n_a long, n_b long", *(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in more), "n long, all_b long", *(f"{c} long" for c in LACKS)]))


def _linked(percent: int) -> str:
    return f"100 * n >= {percent} * (n_a + n_b - n)"


#: Members, and queries, that meet at most in one unit of an opened group; and rows in one task's bucket of units.
MEMBERS, ASKING, PER_TASK = 256, 1024, 20_000
#: Places where two prefixes agree that are held at a time.
MEETINGS = 4 << 20


def _need_both(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that similar sets of these sizes have at least."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _meetings(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """least_meetings() of arrays."""
    rest = lambda n: need(n, percent) - extra(need(n, percent))
    return np.maximum(1, _need_both(a, b, percent) - np.maximum(rest(a), rest(b)))


FACTS = ["row", "size", "hub", "all_hub", "with_hub", "beside", *LACKS]


def candidates(asking: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a query a and a member b of one unit whose bounds allow the threshold.

    Both sides have the columns bucket, unit, FACTS and prefix. Two sets whose prefixes meet too seldom are not similar.
    Nor are two that were compared with the same hub when what they can share of the hub, which is neither more than
    either shares with it nor what both lack of it, and the lesser of their shared tokens beside it do not add up to the
    overlap needed.
    """

    def side(table: pa.Table):
        lists = table.column("prefix").combine_chunks()
        at = lists.offsets.to_numpy().astype(np.int64)
        tokens = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].view(K.U) if len(lists) else np.zeros(0, dtype=K.U)
        owner = np.repeat(np.arange(len(lists)), np.diff(at))
        facts = {c: table.column(c).to_numpy() for c in ("unit", *FACTS)}
        return facts, K.mix(facts["unit"].astype(K.U) + K.U(1))[owner] ^ K.mix(tokens), owner

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        (q, q_key, q_owner), (m, m_key, m_owner) = side(left), side(right)
        order = np.argsort(m_key)
        m_key, m_owner = m_key[order], m_owner[order]
        low = np.searchsorted(m_key, q_key, side="left")
        count = np.searchsorted(m_key, q_key, side="right") - low
        # whole queries at a time, so that what meets is held in pieces
        to = np.concatenate([[0], np.cumsum(count)])
        edge = np.searchsorted(q_owner, np.arange(left.num_rows + 1))
        found, i = [], 0
        while i < left.num_rows:
            j = max(i + 1, int(np.searchsorted(to[edge], to[edge[i]] + MEETINGS, side="right")) - 1)
            mine = slice(edge[i], edge[j])
            hit = np.repeat(q_owner[mine], count[mine]) * np.int64(right.num_rows) + m_owner[K.ragged(low[mine], count[mine])]
            pair, n = np.unique(hit, return_counts=True)
            a, b = pair // right.num_rows, pair % right.num_rows
            keep = n >= _meetings(q["size"][a], m["size"][b], percent)
            lacked = sum(np.bitwise_count((q[c][a] | m[c][b]).view(K.U)).astype(np.int64) for c in LACKS)
            most = np.minimum(np.minimum(q["with_hub"][a], m["with_hub"][b]), q["all_hub"][a] - lacked) + np.minimum(q["beside"][a], m["beside"][b])
            keep &= (q["hub"][a] != m["hub"][b]) | (most >= _need_both(q["size"][a], m["size"][b], percent))
            found.append((q["row"][a[keep]], m["row"][b[keep]]))
            i = j
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"a": a, "b": b})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return meet(left, right)
        finally:
            K.trim()

    members = members.toDF(*members.columns)  # columns of its own, where both come of one table
    return asking.groupBy("bucket").cogroup(members.groupBy("bucket")).applyInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles (distinct k-grams of words) and component_id, the least doc_id reachable by links.

    Two documents link if 100 * intersection >= percent * union. Fewer than k words are one shingle; null texts and texts
    without words have none and link with nothing, not even each other. Equal rows link like any two; a null id counts
    as greater than all others and is its component's id only if no other is there. Other columns are not read; an
    empty table gives no rows.
    """
    return _labelled(docs, k, percent, id_col, text_col).drop("at", "kept_at")


def _labelled(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """jaccard_components() with each row's number and that of its component's first row, by id (null last) and number."""
    small_batches(docs.sparkSession)
    with scratch() as keep:
        total, n_docs = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)), F.count("*")).first()
        bits = min(30, max(0, math.ceil(math.log2(max(1, total / PER_BUCKET)))))
        texts = _texts(docs, id_col, text_col)
        blobs = outgoing(texts, k, bits, hot_tokens(texts, k, n_docs))
        table = keep(written(sets(shared_only(blobs, bits), percent), "sets"))

        # equal sets are one
        heads = table.where("size > 0").groupBy("size", "s1", "s2").agg(F.min("row").alias("head"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("first"))
        able = written(table.where("tokens is not null").join(heads.select(F.col("head")), F.col("row") == F.col("head"), "left_semi"), "able")

        rare = able.select("row", "size", "fame", F.explode("prefix").alias("token"))
        centre = rare.groupBy("token").agg(F.max(F.struct("fame", F.expr("-row").alias("b"))).alias("top"), F.count("*").alias("n")).where("n > 1").select("token", F.expr("-top.b").alias("b"))
        votes = written(rare.join(centre, "token").where("row <> b").groupBy(F.col("row").alias("a"), "b").agg(F.count("*").alias("n")), "votes")
        star = votes.groupBy("a").agg(F.max(F.struct("n", F.expr("-b").alias("b"))).alias("top")).select("a", F.expr("-top.b").alias("b"))
        # of the centres that it meets, a document's hub is the one that most have for a star, be it itself
        stars = star.groupBy("b").agg(F.count("*").alias("fans"))
        own = stars.select(F.col("b").alias("a"), F.col("fans").alias("own"))
        chosen = votes.join(stars, "b").groupBy("a").agg(F.max(F.struct("fans", "n", F.expr("-b").alias("b"))).alias("top")).join(own, "a", "left")
        hub = chosen.where("own is null or own < top.fans").select("a", F.expr("-top.b").alias("b"))
        of_hubs = written(overlaps(written(star.withColumn("hub", F.lit(False)).unionByName(hub.withColumn("hub", F.lit(True))).groupBy("a", "b").agg(F.max("hub").alias("hub")), "hub-pairs"), able), "hubs")
        links = written(of_hubs.where(_linked(percent)).select("a", "b"), "links")
        hubs = of_hubs.where("hub")
        groups = components(links)
        more = written(overlaps(_opened(able, hubs, groups, percent), able).where(_linked(percent)).select("a", "b"), "more")
        final = keep(components(links.unionByName(more)))

        classes = heads.join(final, heads["head"] == final["node"], "left").withColumn("label", F.coalesce("label", "head"))
        # written, so that Spark can split the join of a component that most documents are in
        least = keep(written(classes.groupBy("label").agg(F.min("first").alias("least")), "least"))
    named = classes.join(least, "label").select("size", "s1", "s2", F.col("least.doc_id").alias("component_id"), F.col("least.at").alias("kept_at"))
    full = table.where("size > 0").select("at", "doc_id", "size", "s1", "s2").join(named, ["size", "s1", "s2"]).select("at", "doc_id", F.col("size").alias("n_shingles"), "component_id", "kept_at")
    none = table.where("size = 0").select("at", "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("at").alias("kept_at"))
    return full.unionByName(none)


def _opened(able: DataFrame, hubs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of different groups that the token-group matrix does not rule out.

    Of two groups the smaller one's documents ask, so that one document beside a large group asks once, and the many of
    the group do not each ask it. Opened groups meet their queries in units of bounded size on either side.
    """
    to_hub = hubs.select(F.col("a").alias("row"), F.col("b").alias("hub"), F.col("all_b").alias("all_hub"), F.col("n").alias("with_hub"), *LACKS)
    about = able.select("row", "size", "prefix", F.expr("octet_length(tokens) div 8").alias("shared")).join(to_hub, "row", "left")
    # a document without a hub of its own may be that of others
    own = {"hub": "row", "all_hub": "shared", "with_hub": "shared"}
    about = about.select("row", "size", "prefix", *(F.coalesce(c, d).alias(c) for c, d in own.items()), F.coalesce(F.col("shared") - F.col("with_hub"), F.lit(0)).alias("beside"), *(F.coalesce(c, F.lit(0)).alias(c) for c in LACKS))
    of = about.join(groups.select(F.col("node").alias("row"), "label"), "row", "left").withColumn("g", F.coalesce("label", "row")).drop("label")
    # a group whose members have one hub in common is bound by it as a whole
    one_hub = F.when(F.min("hub") == F.max("hub"), F.min("hub"))
    told_of = [F.count("*").alias("g_n"), F.min("size").alias("low"), F.max("size").alias("high"), one_hub.alias("g_hub"), F.max("with_hub").alias("g_with"), F.max("beside").alias("g_beside"), *(F.bit_and(c).alias(f"g_{c}") for c in LACKS)]
    sizes = of.groupBy("g").agg(*told_of)
    facts = written(of.join(sizes.select("g", "g_n"), "g"), "facts")

    # over the sizes that similar sets can have, the bound is least at an end; 2 make up for rounding
    fewest = lambda low, high: f"(least({least_meetings('size', low, percent)}, {least_meetings('size', high, percent)}) - 2)"
    any_size = f"greatest(1, {fewest(f'(size * {percent} div 100)', f'(size * 100 div {percent} + 1)')})"
    grouped = facts.select(F.posexplode("prefix").alias("place", "token"), *FACTS, "g", "g_n", (F.size("prefix") - F.expr(any_size)).alias("last"))
    cells = written(grouped.groupBy("token", "g").agg(F.max("g_n").alias("g_n"), F.count("*").alias("n")), "matrix")
    open_tokens = cells.groupBy("token").agg(F.max(F.struct("g_n", "g")).alias("top"), F.min(F.struct("g_n", "g")).alias("least")).where("top <> least")
    # tokens of one group only open nothing, nor does the greatest group of a token ask by it; and who must meet in so
    # many tokens meets in one of the rarest, without the last any_size - 1
    asks = grouped.where("place <= last").join(open_tokens.select("token", "top"), "token").where("struct(g_n, g) < top").drop("top", "place", "last")
    told = cells.join(open_tokens.select("token", "least"), "token").where("struct(g_n, g) > least").select("token", F.col("g").alias("other")).join(sizes.select(F.col("g").alias("other"), F.col("g_n").alias("other_n"), "low", "high", "g_hub", "g_with", "g_beside", *(f"g_{c}" for c in LACKS)), "other")
    smaller = "struct(g_n, g) < struct(other_n, other)"
    fits = f"high * 100 >= size * {percent} and size * 100 >= low * {percent}"
    needed = f"({percent} * (size + greatest(low, size * {percent} div 100)) div {100 + percent})"
    lacked = " + ".join(f"bit_count({c} | g_{c})" for c in LACKS)
    by_hub = f"not (hub <=> g_hub and least(with_hub, g_with, all_hub - ({lacked})) + least(beside, g_beside) < {needed})"
    meet = asks.join(told, "token").where(f"{smaller} and {fits} and {by_hub}")
    overlap = meet.groupBy("row", "size", "other", "other_n", "low", "high").agg(F.count("*").alias("n"))
    reach = overlap.withColumns({"low": F.expr(f"greatest(low, size * {percent} div 100)"), "high": F.expr(f"least(high, size * 100 div {percent} + 1)")})
    met = F.expr(f"low <= high and n + {any_size} - 1 >= {fewest('low', 'high')}")
    qualifying = written(reach.where(met).select("row", "other", "other_n"), "open")

    load = written(qualifying.groupBy("other").agg(F.count("*").alias("q_n"), F.max("other_n").alias("g_n")), "load")
    sides = load.select("other", F.expr(f"(g_n + {MEMBERS - 1}) div {MEMBERS}").alias("parts"), F.expr(f"(q_n + {ASKING - 1}) div {ASKING}").alias("turns"), "q_n", "g_n")
    rows = sides.agg(F.coalesce(F.sum(F.expr("q_n * parts + g_n * turns")), F.lit(0))).first()[0]
    n_buckets = max(1, rows // PER_TASK)
    unit = F.xxhash64("other", "part", "turn")
    bucket = F.pmod(unit, F.lit(n_buckets))
    sides = sides.select("other", "parts", "turns")
    part, turn = F.expr("pmod(xxhash64(row, 1), parts)"), F.expr("pmod(xxhash64(row, 2), turns)")
    asked = qualifying.select("row", "other").join(sides, "other").withColumn("turn", turn).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    asking = asked.join(facts.select(*FACTS, "prefix"), "row").withColumn("unit", unit).select(bucket.alias("bucket"), "unit", *FACTS, "prefix")
    belong = facts.select(*FACTS, "prefix", F.col("g").alias("other")).join(sides, "other").withColumn("part", part).withColumn("turn", F.explode(F.expr("sequence(0, turns - 1)")))
    members = belong.withColumn("unit", unit).select(bucket.alias("bucket"), "unit", *FACTS, "prefix")
    return written(candidates(asking, members, percent), "pairs")


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """docs with one row of each component, the first of those with the least doc_id (null last); rows without words stay."""
    table = numbered(docs, "rows")
    with scratch() as keep:
        gone = keep(written(_labelled(table, **kw).where("at <> kept_at").select("at"), "gone"))
    return without_ids(table, gone, ROW).drop(ROW)
