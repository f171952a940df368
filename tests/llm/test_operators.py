"""Each operator against brute force on the smallest documents, and on odd, repeated and missing rows."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import blobs, decontaminate, jaccard, katz, licenses, linededup, packing, queries, repetition, sharding, tokencount, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def rows(df):
    return df.select("doc_id", "text").collect()


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.fixture(params=["docs", "odd"])
def table(request):
    return request.getfixturevalue(request.param)


def test_repetition(table):
    def want(text):
        text = text or ""
        w = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        at = collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)

    got = repetition.repetition_quality(table).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(((r.doc_id, *want(r.text)) for r in rows(table)), key=key)
    assert not any(r.kept and r.base_failed for r in got)


def test_repetition_shares(spark):
    text = "one two three four five six seven eight nine ten " * 2 + " ".join(f"u{i}" for i in range(40))
    r = repetition.repetition_quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    chars = sum(map(len, text.split()))
    assert abs(r.dup_5 - sum(map(len, text.split()[:10])) / chars) < 1e-12 and r.n_repeat_words == 20


def test_toxicity(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    data, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [word() for _ in range(40)]
        if bad:
            w[7] = rng.choice(["zorkface", f"gruk{word()}"])
        data.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    data += [(1000, None), (1001, ""), (1000, "zorkface")]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = toxicity.toxicity_report(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(data)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(held) > 80 and all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_toxicity_without_labels(odd, spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity_report(odd, labels).count() == odd.count()
    assert toxicity.toxicity_report(empty, labels).count() == 0
    kept = toxicity.without_toxic(odd, toxicity.fit(odd, labels))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_grammar():
    g = toxicity.grammar(quiet=0.5, said=0.5, aimed=2.0)

    def weigh(*symbols):
        state, total = 0, 0.0
        for s in symbols:
            _, w, state = g.step(state, s)
            total += w if s in (toxicity.INSULT, toxicity.THREAT) else 0
        return total

    t = toxicity
    assert weigh(t.INSULT) == 1 and weigh(t.NEGATION, t.INSULT) == 0.5 and weigh(t.TARGET, t.INSULT) == 2
    assert weigh(t.THREAT) == 0.5 and weigh(t.TARGET, t.THREAT) == 2 and weigh(t.REPORT, t.INSULT) == 0.5
    assert weigh(t.NEGATION, t.OTHER, t.OTHER, t.OTHER, t.INSULT) == 1 and weigh(t.QUOTE, t.INSULT, t.QUOTE, t.INSULT) == 1.5


def test_licenses(table):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def want(text):
        w = word.findall((text or "").translate(LOW))
        found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in found]
        return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))

    got = licenses.license_report(table).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((r.doc_id, *want(r.text)) for r in rows(table)), key=key)


def test_license_notice_with_gaps(spark):
    w = licenses.NOTICES["bsd"].split()
    text = "lead in " + " ".join(w[:10]) + " extra word " + " ".join(w[10:20] + w[21:]) + " and more"
    d = spark.createDataFrame([(1, text), (2, "GNU GNU General Public License, cc by cc by"), (3, "of the " * 500)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_report(d).collect()}
    assert got[1].labels == "bsd" and got[1].n_base == 0 and got[1].score > 0.8
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 1, 7, "cc-by,gpl") and got[3].labels == ""


def lines_by_force(data, min_words=8):
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is not None, data[i][0] or 0, i))
    found = [(data[i][0], n, i, tuple(WORD.findall(line.translate(LOW)))) for i in order for n, line in enumerate((data[i][1] or "").split("\n"))]
    found = [x for x in found if x[3]]

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < min_words:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    first = {}
    for x in found:
        first.setdefault(x[3], x)
    shape = collections.defaultdict(list)
    for x in first.values():
        shape[len(x[3])].append(x)
    out = []
    place = {id(x): n for n, x in enumerate(found)}
    for x in found:
        close = [y for m in (-1, 0, 1) for y in shape[len(x[3]) + m] if place[id(y)] < place[id(first[x[3]])] and near(x[3], y[3])]
        if close:
            y = min(close, key=lambda y: place[id(y)])
            out.append((x[0], x[1], y[0], y[1], 1))
        elif first[x[3]] is not x:
            out.append((x[0], x[1], first[x[3]][0], first[x[3]][1], 0))
    return sorted(out, key=key)


def test_line_dedup(spark, odd):
    base = [f"w{i}" for i in range(12)]
    line = " ".join
    data = [
        (1, line(base)), (2, line(base[:5] + ["zz"] + base[6:])), (3, line(base[:4] + base[5:])), (4, line([*base[:8], "more", *base[8:]])), (5, line(base[:2] + ["a", "b"] + base[4:])),
        (6, "a b c\na b c\na b d"), (7, "\n\n \n" + line(base).upper()), (8, line(["q"] + base[1:11] + ["r"])), (9, line(base[::-1])), (10, line(base[1:] + base[:1])),
        (0, line([*base[1:], "end"])), (11, None), (12, ""), (12, line(base)), (None, "x " * 9),
    ]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = linededup.duplicate_lines(d).drop("row").collect()
    assert sorted(map(tuple, got), key=key) == lines_by_force(data)
    rest = {r.doc_id: r.text for r in linededup.without_lines(d, linededup.duplicate_lines(d)).where("doc_id <> 12").collect()}
    assert rest[6] == "a b c\na b d" and 2 not in rest and rest[11] is None
    assert linededup.duplicate_lines(odd).count() >= 2


def test_line_dedup_keeps_one_of_repeated_rows(spark):
    """The lines that go are those of one row: not of all rows with its id, and of rows without an id as well."""
    text = "\n".join(f"line {i} of the text" for i in range(3))
    data = [(7, text), (7, text), (8, "only here"), (8, "line 0 of the text\nother words"), (None, "no id"), (None, "no id")]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in linededup.deduped(d).collect()), key=key)
    assert got == sorted([(7, text), (8, "only here"), (8, "other words"), (None, "no id")], key=key)


def edits_by_force(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_by_length(spark):
    """Edits in proportion to the length, also where an earlier line of another kind holds the same words in a row."""
    import random

    rng = random.Random(3)
    shared = [f"s{i}" for i in range(20)]
    base = [[*(f"b{g}w{i}" for i in range(n)), *shared] for g, n in enumerate((18, 19, 25, 40, 61, 100))]
    data = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, len(w) // 20 + 2)):
            at, new = rng.randrange(len(w)), f"e{rng.randrange(10**6)}"
            w[at : at + rng.randint(0, 1)] = rng.choice(([new], []))
        data.append((i, " ".join(w)))
    got = linededup.duplicate_lines(spark.createDataFrame(data, "doc_id long, text string"), words_an_edit=20).collect()
    words = [t.split() for _, t in data]
    bound = lambda i, j: max(1, max(len(words[i]), len(words[j])) // 20)
    away = {(i, j): edits_by_force(words[i], words[j]) for i in range(len(data)) for j in range(i)}
    assert {r.doc_id for r in got} == {i for (i, j), n in away.items() if n <= bound(i, j)}
    assert all(r.kept_doc_id < r.doc_id and away[r.doc_id, r.kept_doc_id] == r.edits <= bound(r.doc_id, r.kept_doc_id) for r in got)
    assert sum(r.edits > 1 for r in got) > 10


def test_lines_of_other_words_are_not_slid(monkeypatch):
    """Long lines whose words differ too much as bags are told apart without following any diagonal; others count as before."""
    import random

    rng = random.Random(7)
    a = np.array([rng.randrange(300) for _ in range(400)], dtype="<u4")
    b = a.copy()
    b[[5, 90, 200]] = 10**6
    assert linededup._left_over(a, b) == (3, 3) and linededup._edits(a, b, 3) == linededup._edits(b[:90], a[:90], 1) + 2 == 3
    for _ in range(30):
        c = np.delete(a, rng.randrange(400)) if rng.random() < 0.5 else a.copy()
        c[rng.sample(range(399), rng.randint(0, 12))] = rng.randrange(300)
        away = edits_by_force(a.tolist(), c.tolist())
        assert max(linededup._left_over(a, c)) <= away and linededup._edits(a, c, 8) == (away if away <= 8 else -1)
    monkeypatch.setattr(linededup.np, "flatnonzero", lambda x: pytest.fail("slid"))
    assert linededup._edits(a, a + 10**6, 20) == -1


def test_blobs_in_part():
    packed = blobs.pack(h=np.arange(5, dtype=np.uint64), line=np.arange(3, dtype=np.uint8), print=np.arange(7, dtype=np.int64))
    got = blobs.unpack(packed, ("line", "print"))
    assert list(got) == ["line", "print"] and got["print"].tolist() == list(range(7)) and got["line"].tolist() == [0, 1, 2]


def test_line_dedup_of_documents(docs):
    data = [(r.doc_id, r.text) for r in rows(docs)]
    assert sorted(map(tuple, linededup.duplicate_lines(docs).drop("row").collect()), key=key) == lines_by_force(data)


def test_decontamination(spark, odd):
    item = [f"b{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "three short words")], "item_id long, text string")
    other = lambda n, m: [f"o{n}x{i}" for i in range(m)]
    data = [
        (1, " ".join(other(1, 50) + item + other(2, 50))), (2, " ".join(other(3, 9) + item[20:] + other(4, 9) + item[:20])), (3, " ".join(other(5, 60) + item[:15])), (4, " ".join(item[::-1])), (5, None), (5, " ".join(item).upper()), (6, "three short words"),
    ]
    d = spark.createDataFrame(data, "doc_id long, text string")
    for limit in (1 << 20, 0):  # broadcast, and joined by a shuffle
        got = {(r.doc_id, r.item_id): (r.cover, r.n_tiles) for r in decontaminate.contamination(d, bench, broadcast_bytes=limit).collect()}
        assert got == {(1, 1): (1.0, 1), (2, 1): (1.0, 2), (5, 1): (1.0, 1)}
    assert sorted(r.doc_id for r in decontaminate.clean(d, bench).collect()) == [3, 4, 6]
    assert decontaminate.contamination(odd, bench).count() == 0 and decontaminate.contamination(d, bench.where("false")).count() == 0


def test_tiles_are_greedy():
    seeds = [(i, i) for i in range(6)] + [(i + 5, i + 10) for i in range(4)]
    tiles = decontaminate.tile(np.array([a for a, _ in seeds]), np.array([p for _, p in seeds]), 2)
    assert tiles == [(0, 0, 7), (7, 12, 3)]  # the second match loses the words that the longer one holds


def test_packing(table):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    cap = 256
    want = collections.Counter()
    for r in rows(table):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), cap):
            part = ids[i : i + cap]
            want[r.doc_id, i // cap, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack(table, path, capacity=cap).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    room = collections.defaultdict(list)
    for r in got:
        room[r.sequence_id].append((r.offset, r.length))
    for parts in room.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= cap
    assert len(room) <= math.ceil(sum(r.length for r in got) / cap) * 1.1 + 1


def test_bin_completion_finds_the_best():
    rng = np.random.default_rng(5)
    for _ in range(50):
        items = sorted(rng.integers(1, 30, 9).tolist())
        left = collections.Counter(items)
        room = int(rng.integers(10, 60))
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= room}
        assert sum(packing.completion(sorted(left), dict(left), room, effort=10**6)) == max(sums)
    h = {7: 3, 5: 4, 3: 10, 1: 2}
    got = packing.plan(h, 10)
    assert collections.Counter(x for f, t in got for x in f * t) == collections.Counter(h) and all(sum(f) <= 10 for f, _ in got)


def test_bin_completion_of_many_lengths():
    """With the effort that pack() uses: one length of some hundred fills the room."""
    for odd in (35, 611, 1205):
        left = collections.Counter({6 * i: 2 for i in range(2, 500)})
        left[odd] += 1
        assert sum(packing.completion(sorted(left), dict(left), 3600 + odd % 6)) == 3600 + odd % 6
    left = {6 * i: 3 for i in range(2, 500)}
    assert sum(got := packing.completion(sorted(left), left, 3605)) == 3600 and all(n <= left[x] for x, n in collections.Counter(got).items())
    assert packing.fullest([4, 5], {4: 2, 5: 1}, 14) == [5, 4, 4] and packing.fullest([7], {7: 3}, 6) == []


def components_by_force(data, k=5, percent=75):
    sets = []
    for _, text in data:
        w = WORD.findall((text or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(data, sets, strict=True))), key=key)


def near_texts():
    import random

    rng = random.Random(7)
    base = [[f"t{g}w{i}" for i in range(rng.randint(30, 120))] for g in range(6)]
    data = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        data.append((i, " ".join(w)))
    return [*data, (500, None), (501, ""), (502, " \n"), (503, "a b"), (504, "A  b"), (505, "b a"), (506, "a b c d e"), (3, data[3][1]), (None, data[5][1]), (None, "alone")]


def test_jaccard(spark, docs):
    for data in (near_texts(), [(r.doc_id, r.text) for r in rows(docs)]):
        d = spark.createDataFrame(data, "doc_id long, text string")
        got = jaccard.jaccard_components(d).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=key) == components_by_force(data)


def test_jaccard_with_hot_tokens(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_TOTAL", 5)
    monkeypatch.setattr(jaccard, "PER_BUCKET", 4096)
    data = near_texts()
    got = jaccard.jaccard_components(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in got), key=key) == components_by_force(data)


def test_one_of_each(spark, odd, empty):
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 7, 8, 9]
    assert jaccard.jaccard_components(empty).count() == 0


def test_one_of_each_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    alone = " ".join(f"v{i}" for i in range(40))
    data = [(4, text), (4, text), (9, text), (None, text), (4, alone), (None, "no id"), (None, "no id"), (5, None), (5, None)]
    got = jaccard.one_of_each(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=key) == sorted([(4, text), (4, alone), (None, "no id"), (5, None), (5, None)], key=key)


def test_token_counts(table):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in rows(table)), key=key)
    assert sorted(map(tuple, tokencount.token_counts(table, path).collect()), key=key) == want


def test_token_counts_of_odd_strings():
    import random

    import pyarrow as pa

    from weft.llm import kernel as K

    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "1", "23", "!", " ", "　", "<|endoftext|>", "hello", "…", "\x1c", "́", "🎉", "aaaa", "\r\n", "\x85", "\xa0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, model, got = Tokenizer.from_file(path), tokencount.load(path), []
    memo = [np.zeros(0, K.U), np.zeros(0, np.int64)]
    for _, raw, off in K.blocks([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])], limit=5000):
        got += tokencount.count_block(model, raw, off, memo).tolist()
    assert got == [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]


def test_shards(table):
    for limit in (2000, 40_000, 1 << 30):
        got = sharding.shards(table, limit).collect()
        assert collections.Counter((r.doc_id, r.n_bytes) for r in got) == collections.Counter((r.doc_id, len((r.text or "").encode())) for r in rows(table))
        size, count = collections.Counter(), collections.Counter()
        for r in got:
            size[r.shard] += r.n_bytes
            count[r.shard] += 1
        assert all(n <= limit or count[s] == 1 for s, n in size.items())
        names = sorted({r.shard for r in got if "." not in r.shard})
        assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False) if a != b)
        parents = collections.Counter()
        for r in got:
            for i in range(len(r.shard.split(".")[0])):
                parents[r.shard[:i]] += r.n_bytes
        assert all(n > limit for n in parents.values())  # no bucket split that fitted


def test_katz(table):
    data = [(r.doc_id, [*WORD.findall((r.text or "").translate(LOW)), "</s>"], zlib.crc32(str(r.doc_id).encode()) % 5 != 1 if r.doc_id is not None else True) for r in rows(table)]
    u, b, h = collections.Counter(), collections.Counter(), collections.Counter()
    for _, w, learn in data:
        if learn:
            u.update(w)
            b.update(zip(["<s>", *w[:-1]], w, strict=True))
            h.update(["<s>", *w[:-1]])
    n, v = sum(u.values()), len(u)
    of = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.CUTOFF + 2)]
    du, db = katz.discounts(of(u)), katz.discounts(of(b))
    less = lambda c, d: c - katz.DELTA if c > katz.CUTOFF else d[c] * c
    p1 = {w: less(c, du) / n for w, c in u.items()}
    unknown = 1 - sum(p1.values())
    mass, seen = collections.Counter(), collections.Counter()
    for (a, w), c in b.items():
        mass[a] += less(c, db) / h[a]
        seen[a] += p1[w]
    alpha = {a: (1 - mass[a]) / (1 - seen[a]) for a in h}
    for a in list(h)[:20]:  # the weights are normalised
        total = sum(less(b[a, w], db) / h[a] if b[a, w] else alpha[a] * p1[w] for w in u) + alpha[a] * unknown
        assert abs(total - 1) < 1e-9
    want = []
    for d, w, learn in data:
        base = sum(math.log10((u[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = sum(math.log10(less(b[a, x], db) / h[a] if b[a, x] else (alpha[a] if a in h else 1) * p1.get(x, unknown)) for a, x in zip(["<s>", *w[:-1]], w, strict=True))
        want.append((d, not learn, len(w), sum(x in u for x in w), n, round(base, 5), round(score, 5)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in katz.katz_report(table).collect()]
    for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-4 and abs(x[6] - y[6]) < 1e-4


def test_katz_gives_back_small_batches():
    """A block's or a bucket's blobs leave the worker in batches of about OUT bytes, not in one; all are there, in order."""
    sent = [(0, i, bytes(katz.OUT // 3 - 1)) for i in range(10)] + [(1, 10, bytes(2 * katz.OUT)), (1, 11, b"x")]
    got = list(katz._batches(sent))
    assert [b.num_rows for b in got] == [3, 3, 3, 1, 1, 1]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == sent
    assert [b.num_rows for b in katz._batches([])] == [0]


def test_katz_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = katz.katz_report(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_katz_with_nothing_to_learn(odd):
    got = katz.katz_scores(odd, F.lit(False)).collect()
    assert len(got) == odd.count() and all(r.score == 0 and r.train_tokens == 0 for r in got)


@pytest.mark.parametrize("f", [repetition.repetition_quality, licenses.license_report, linededup.duplicate_lines, sharding.shards, katz.katz_report, lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")), lambda d: tokencount.token_counts(d, public_tokenizers.path("byte_bpe_50k.json"))])
def test_empty_tables(f, empty):
    assert f(empty).count() == 0


def test_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))


def test_shards_of_repeated_rows(spark):
    """Pages of repeated rows hold whole rows within the limit."""
    d = spark.createDataFrame([(1, "x" * 10)] * 7 + [(2, "y" * 40)] * 2 + [(3, "z")], "doc_id long, text string").repartition(3)
    size, count = collections.Counter(), collections.Counter()
    for r in sharding.shards(d, 25).collect():
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
    assert all(n <= 25 or count[s] == 1 for s, n in size.items())
    assert sum(count.values()) == 10 and sorted(size.values()) in ([1, 10, 20, 20, 20, 40, 40], [11, 20, 20, 20, 40, 40])


def test_written_shards_hold_every_row(spark, odd, tmp_path):
    """Rows without an id, repeated rows and two texts of one id: each in the shard that its own text belongs to."""
    sharding.write_shards(odd, str(tmp_path / "odd"), 2000)
    got = spark.read.option("basePath", str(tmp_path / "odd")).parquet(str(tmp_path / "odd"))
    assert sorted((tuple(r) for r in got.select(odd.columns).collect()), key=key) == sorted(map(tuple, odd.collect()), key=key)
    d = spark.createDataFrame([(1, "a" * 50), (1, "b" * 50), (None, "c" * 10)], "doc_id long, text string")
    sharding.write_shards(d, str(tmp_path / "two"), 60)
    size = spark.read.parquet(str(tmp_path / "two")).groupBy("shard").agg(F.sum(F.length("text")).alias("n")).collect()
    assert sum(r.n for r in size) == 110 and all(r.n <= 60 for r in size)
    of = sharding.directory(sharding.shards(d, 60)).collect()
    assert sorted(r.n_bytes for r in of) == sorted(r.n for r in size)


def test_words_met_before_alone():
    """A block may hold no word that its task has not met, or words for the library alone."""
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for texts in (["some words here", "and Ünï <x>"], ["words some", ""], ["日本 don't"], ["日本 <x>", "here"], ["", "  "]):
        raw = [t.encode() for t in texts]
        ids, to = words.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [ids[a:b].tolist() for a, b in zip(to, to[1:], strict=False)] == [words.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_is_never_worse_than_best_fit():
    rng = np.random.default_rng(2)
    for low, high, count in ((700, 2300, 300), (1000, 1400, 400), (10, 4096, 500)):
        h = collections.Counter(rng.integers(low, high, count).tolist())
        used = lambda patterns: sum(t for _, t in patterns)
        got = packing.plan(h, 4096)
        assert collections.Counter({n: sum(f.count(n) * t for f, t in got) for n in h}) == h and all(sum(f) <= 4096 for f, _ in got)
        assert used(got) <= used(packing._filled(h, 4096, packing.best_fit))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(name, spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
