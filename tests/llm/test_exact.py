"""Operators with exact contracts against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from strataloom.llm import chunks, decontaminate, media, packing, repeats, sharding, simhash
from strataloom.llm.common import FILE_BYTES, Hidden, components, stored

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def key(row):
    return tuple((v is None, str(v)) for v in row)


def docs_of(seed, n=80):
    draw = random.Random(seed)
    parts = ["".join(draw.choice("ab cdeé日") for _ in range(k)) for k in (30, 50, 45, 80, 200)]
    out = [(i, "".join(draw.choice(parts) if draw.random() < 0.5 else "".join(draw.choice("abcé ") for _ in range(draw.randint(1, 60)))
                       for _ in range(draw.randint(0, 12)))) for i in range(n)]
    return out + [(300, None), (301, ""), (302, "a" * 500), (303, "ab" * 300), (None, "xyz" * 40), (302, "a" * 500)]


def removed_by_hand(docs, n):
    """What the contract says of each row, from all n-byte strings."""
    seen = Counter(r[k : k + n] for _, t in docs for r in [(t or "").encode()] for k in range(len(r) - n + 1))
    want = []
    for i, t in docs:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for k in range(len(raw) - n + 1):
            if seen[raw[k : k + n]] > 1:
                mark[k : k + n] = b"\1" * n
        kept = bytes(x for x, y in zip(raw, mark) if not y)
        spans = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        want.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(want, key=key)


@pytest.mark.parametrize("variants", [0, 2, 1000])
def test_repeats(spark, variants):
    docs, n = docs_of(3), 60
    got = repeats.removed_repeats(spark.createDataFrame(docs, SCHEMA), n, gram=24, max_variants=variants, bucket_bytes=3000).drop("kept_text")
    assert sorted(map(tuple, got.collect()), key=key) == removed_by_hand(docs, n)


def test_repeats_sort_no_texts(spark):
    """Joins hash their side of numbers; anchors, contexts and texts are not sorted, nor does the result change."""
    docs, n, was = docs_of(5), 60, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = spark.createDataFrame([(k, t or "") for k, (_, t) in enumerate(docs)], "rid long, text string")
        marks = repeats.repeat_spans(base, n, gram=24, max_variants=2)[1]
        plan = marks._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        got = repeats.removed_repeats(spark.createDataFrame(docs, SCHEMA), n, gram=24, max_variants=2).drop("kept_text")
        assert sorted(map(tuple, got.collect()), key=key) == removed_by_hand(docs, n)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_strings_whose_only_partner_repeats_further(spark):
    """Two texts share a long stretch, a third shares one to thirty bytes less of it, many share the rest."""
    draw = random.Random(23)
    junk = lambda k: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    docs = []
    for _ in range(4):
        left, shared, right = junk(50), junk(70), junk(50)
        docs += [junk(40) + left + shared + right + junk(40) for _ in range(2)]
        docs += [junk(40) + left[-k:] + shared + right[: draw.randint(0, 30)] + junk(40) for k in (1, 2, 5, 9, 17, 30)]
        docs += [junk(40) + shared + junk(40) for _ in range(12)]
    docs = list(enumerate(docs))
    for variants in (0, 3):
        got = repeats.removed_repeats(spark.createDataFrame(docs, SCHEMA), 60, gram=24, max_variants=variants).drop("kept_text")
        assert sorted(map(tuple, got.collect()), key=key) == removed_by_hand(docs, 60)


def test_short_texts_that_hold_a_gram_twice(spark):
    draw = random.Random(11)
    junk = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    texts = [junk(n - 390) + junk(130) * 3 for n in (400, 430, 450, 500, 600, 671) for _ in range(6)]
    texts += ["abc" * 200, junk(7) + "xy" * 220, junk(41) * 12, junk(450)]

    def covered(raw):
        counts = Counter(raw[i : i + 400] for i in range(len(raw) - 399))
        return len({k for i in range(len(raw) - 399) if counts[raw[i : i + 400]] > 1 for k in range(i, i + 400)})

    want = [covered(t.encode()) for t in texts]
    assert not any(want[:36]) and all(want[36:39])
    for options in ({}, {"max_variants": 0}):
        rows = repeats.removed_repeats(spark.createDataFrame(list(enumerate(texts)), SCHEMA), **options).collect()
        assert [r.n_removed for r in sorted(rows, key=lambda r: r.doc_id)] == want


def test_passages_of_over_50_words_across_documents(spark):
    """Whole from 400 bytes on, the contract's length; shorter ones, 51 words of five letters among them, need a lower `length`."""
    draw = random.Random(29)
    word = lambda k: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    docs, sizes = [], [305, 399, 400, 401, 650]
    for size in sizes:
        passage = " ".join([word(5) for _ in range(51)] + [word(size - 306)] * (size > 305))
        assert len(passage) == size and len(passage.split()) > 50
        # Surroundings differ next to the passage, so that no more than it is shared.
        docs += [f"{word(300)}{a}{passage}{b}{word(300)}" for a, b in ("pq", "rs")]
    for length in (400, 300):
        rows = repeats.removed_repeats(spark.createDataFrame(list(enumerate(docs)), SCHEMA), length).collect()
        want = [n if n >= length else 0 for n in sizes for _ in range(2)]
        assert [r.n_removed for r in sorted(rows, key=lambda r: r.doc_id)] == want


def test_run_length_index():
    texts = [b"banana bandana", b"ananas", b"", b"banana"]
    index = repeats.RunLengthIndex(texts)
    stats = index.matching_statistics()
    every = b"\0".join(texts)
    for t, text in enumerate(texts):
        for k in range(len(text)):
            best = max((n for n in range(1, len(text) - k + 1)
                        if sum(text2[j : j + n] == text[k : k + n] for text2 in texts for j in range(len(text2) - n + 1)) > 1), default=0)
            assert stats[index.starts[t] + k] == best
    assert sum(n for _, n in index.runs) == index.n and len(every) < index.n + 1


def test_suffixes_in_order():
    """Sorted by symbols, a text's end before all bytes, equal suffixes by text; ranks take four bytes each."""
    draw = random.Random(13)
    for _ in range(60):
        base = bytes(draw.choices(b"ab", k=90))
        texts = [base[draw.randrange(60):] if draw.random() < 0.5 else bytes(draw.choices(b"a\x00\xff", k=draw.randrange(25))) for _ in range(8)]
        index = repeats.RunLengthIndex(texts)
        want = sorted((tuple(b + 1 for b in text[k:]), t, int(index.starts[t]) + k) for t, text in enumerate(texts) for k in range(len(text) + 1))
        order = index._suffixes()
        assert order.tolist() == [at for _, _, at in want] and order.dtype == np.int32


def slow_chunks(raw, least, bits, most):
    gear = [int(x) for x in chunks._GEAR]
    h, hashes = 0, []
    for b in raw:
        h = (h * 2 + gear[b]) & 0xFFFF
        hashes.append(h)
    start = lambda i: i >= len(raw) or raw[i] & 0xC0 != 0x80
    ends, last = [], 0
    while last < len(raw):
        cut = next((e for e in range(last + least, min(len(raw), last + most) + 1) if hashes[e - 1] >> (16 - bits) == 0 and start(e)), None)
        if cut is None:
            cut = min(len(raw), last + most)
            while not start(cut):
                cut -= 1
        ends.append(cut)
        last = cut
    return ends


def test_chunks(spark):
    docs = docs_of(5)
    base = spark.createDataFrame(docs, SCHEMA).coalesce(1)
    first, cuts = {}, []
    for k, (_, t) in enumerate(docs):
        raw = (t or "").encode()
        ends = slow_chunks(raw, chunks.LEAST, chunks.BITS, chunks.MOST)
        cuts.append((raw, list(zip([0, *ends], ends))))
        for a, b in cuts[-1][1]:
            first.setdefault(raw[a:b], (k, a))
    want = []
    for k, (raw, spans) in enumerate(cuts):
        runs = []
        for a, b in spans:
            if first[raw[a:b]] != (k, a):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        whole = [(a, b) for a, b in runs if (a, b) == (0, len(raw))]
        runs = whole or [r for r in runs if r[1] - r[0] >= 40]
        edges = [0, *(x for r in runs for x in r), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
        want.append((docs[k][0], None if docs[k][1] is None else kept.decode(), len(raw), len(raw) - len(kept), len(runs)))
    hidden, cut = chunks.chunk_cuts(base, run_bytes=40)
    got = cut.select(hidden["doc_id"], "text", "n_bytes", "n_removed", "n_spans")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, chunks.deduplicated(base, run_bytes=40).collect()), key=key) == sorted([w[:2] for w in want], key=key)
    assert any(r[3] for r in want)


def test_chunks_resist_insertions():
    raw = bytes(random.Random(1).randrange(97, 123) for _ in range(20000))
    moved = raw[:5000] + b"inserted" + raw[5000:]

    def digests(r):
        data = np.frombuffer(r, np.uint8)
        off = np.array([0, len(r)])
        return {tuple(d) for d in chunks._digests(data, off, chunks.chunk_ends(data, off))[0].tolist()}

    assert len(digests(raw) & digests(moved)) > 0.97 * len(digests(raw))


def test_simhash_components(spark):
    docs = docs_of(7) + [(400 + i, "one two three four five " * 3 + "x" * (i % 3)) for i in range(9)]
    words = re.compile(r"[^\x20\x09-\x0D]+")
    prints = []
    for _, t in docs:
        w = words.findall((t or "").translate(LOWER))
        s = [" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        ones = sum((np.array([xxhash.xxh64_intdigest(x, 42) >> b & 1 for b in range(64)]) for x in s), np.zeros(64, int))
        prints.append(sum(1 << b for b in range(64) if s and 2 * ones[b] > len(s)))
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    want = [(docs[a][0], f"{prints[a]:016x}", least.get(find(a))) for a in range(len(docs))]
    for bucket in (1, 32):
        got = simhash.simhash_components(spark.createDataFrame(docs, SCHEMA), max_bucket=bucket)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_near_duplicates(spark):
    draw = random.Random(2)
    texts = [[f"w{draw.randrange(500)}" for _ in range(n)] for n in (30, 60, 120, 240) for _ in range(4)]
    rows = []
    for t in texts:
        for edits in (0, 1, 2, 5):
            w = list(t)
            for _ in range(edits):
                w[draw.randrange(len(w))] = "new"
            rows.append((len(rows), " ".join(w)))
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for _, t in rows for w in [t.split()]]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.rid: r.root for r in simhash.near_duplicates(spark.createDataFrame(rows, "rid long, text string")).collect()}
    assert [got.get(a, a) for a in range(len(rows))] == [find(a) for a in range(len(rows))]


def test_near_duplicates_of_crowded_keys(spark):
    draw = random.Random(7)
    rows, want = [], []
    for _ in range(2):  # copies of a base that comes last: alike to it, hardly to each other
        base, first = [f"w{draw.randrange(5000)}" for _ in range(200)], len(rows)
        for _ in range(120):
            w = list(base)
            for at in draw.sample(range(10, 190), 4):
                w[at] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(base)))
        own = [frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for _, t in rows[first:] for w in [t.split()]]
        joined = [k for k, s in enumerate(own) if len(s & own[-1]) >= 0.8 * len(s | own[-1])]
        assert len(joined) > 100
        want.append({first + k for k in joined})
    got = {}
    for r in simhash.near_duplicates(spark.createDataFrame(rows, "rid long, text string")).collect():
        got.setdefault(r.root, set()).add(r.rid)
    for group in want:
        assert any(group <= g for g in got.values())


def test_alike_sets_share_a_key():
    """No pair of sets that are 0.8 alike misses a key of the same kind, of whatever size they are."""
    draw = np.random.default_rng(9)
    for k in range(24000):
        n = int(draw.integers(1, 63) if k % 6 else draw.integers(63, 1500))
        union = draw.integers(0, 1 << 63, n).astype(np.uint64)
        apart = n // 5 if k % 2 else int(draw.integers(0, n // 5 + 1))
        mine = int(draw.integers(0, apart + 1))
        x, y = np.unique(union[mine:]), np.unique(np.concatenate([union[:mine], union[apart:]]))
        if not len(x) or not len(y) or len(np.intersect1d(x, y)) < 0.8 * len(np.union1d(x, y)):
            continue
        assert any(len(np.intersect1d(a, b)) for a, b in zip(simhash.segment_keys(x), simhash.segment_keys(y))), (x, y)


def test_near_duplicates_by_later_classes(spark):
    """With few first classes the later ones find what is left, for crowded keys too."""
    draw = random.Random(5)
    rows, bases = [], [[f"w{draw.randrange(5000)}" for _ in range(300)] for _ in range(30)]
    for base in bases:
        for copy in range(draw.choice((1, 2, 14))):
            w = list(base)
            for at in range(4):
                w[10 + 60 * at + draw.randrange(20)] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for _, t in rows for w in [t.split()]]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(rows, "rid long, text string")
    for first in (0, 1):
        got = {r.rid: r.root for r in simhash.near_duplicates(frame, first=first).collect()}
        assert [got.get(a, a) for a in range(len(rows))] == [find(a) for a in range(len(rows))]


def test_word_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    words, whole, draw = packing.word_ids(path), Tokenizer.from_file(path), random.Random(4)
    assert packing.word_ids(path) is words  # a worker keeps what it remembers for its next task
    marks = [chr(c) for c in range(0x180)] + ["'s", "'LL", "we're", "don't", " ", " ", "\n", "the", "Ortionst", "\x1c", "\x1f", "\x85", "\xa0", "\u0130"]
    texts = ["".join(draw.choices(marks, k=draw.randrange(1, 40))) for _ in range(3000)]
    texts += ["".join(chr(draw.randrange(0x20, 0x7F)) for _ in range(60)) for _ in range(2000)] + ["a\x1cb", "it'se 'tis", "x\x85y", ""]
    for text in texts * 2:
        assert words.of(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_a_large_group_gathers_in_few_rounds(spark):
    """One group over all shards took a round for each shard that it fills."""
    cells = [("big", s, 100 + s) for s in range(20)] + [(f"g{k}", s, 1 + (k + s) % 3) for k in range(60) for s in (k % 20, (7 * k + 3) % 20)]
    held = Counter()
    for _, s, n in cells:
        held[s] += n
    quota = [max(held.values()) + 100] * 20
    got = [tuple(r) for r in sharding.propagate(spark.createDataFrame(cells, "g string, shard int, n long"), quota, rounds=4).collect()]
    load, rows, was, used = Counter(), Counter(), Counter(), defaultdict(set)
    for g, _, n in cells:
        was[g] += n
    for g, s, n in got:
        load[s] += n
        rows[g] += n
        used[g].add(s)
    assert rows == was and all(load[s] <= quota[s] for s in load)
    assert len(used["big"]) <= 13 and sum(len(x) == 1 for x in used.values()) >= 50


def test_ids_of_a_column_are_the_tokenizers(monkeypatch):
    """Columns of texts, other scripts and blanks of every kind among them, and few runs remembered."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    words, whole, draw = packing.WordIds(path), Tokenizer.from_file(path), random.Random(8)
    marks = [chr(c) for c in range(0x180)] + ["'s", " ", " ", "\n", "the", "Straße", "élève", "\u0130", "\u4e2d", "\u2028", "\U0001f600", "<|end|>", "\u200b"]
    texts = ["".join(draw.choices(marks, k=draw.randrange(0, 40))) for _ in range(2000)] + ["", " ", "\t a \xa0", "é" * 3000]
    for part in (texts, texts[:1], [""], texts[-3:]):
        ids, ends = words.of_texts(pa.array([*part, "x"]).slice(0, len(part)), np.array([1], "<u4").tobytes())
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [whole.encode(t, add_special_tokens=False).ids + [1] for t in part]
        assert len(words) <= 50 and len(words.old) <= 50


def test_only_keys_of_refused_pairs_stay_open(spark):
    """A text's other keys, and components that no refused pair parts from another, were looked at again."""
    members = spark.createDataFrame([(1, [7, 8]), (2, [7]), (3, [7, 8]), (4, [8]), (5, [7, 9]), (6, [9])], "rid long, keys array<long>")
    roots = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "rid long, root long")
    failed = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "u long, v long")
    placed, left = simhash._still_parted(members, roots, failed)
    assert sorted(tuple(r) for r in placed.collect()) == [(7, 1, 1), (7, 2, 1), (7, 3, 3)]
    assert sorted((r.rid, r["keys"]) for r in left.collect()) == [(1, [7]), (2, [7]), (3, [7])]


def test_small_tables_are_written_in_few_files(spark):
    cores = spark.sparkContext.defaultParallelism
    for rows in (500, FILE_BYTES // 2):  # of 8 bytes
        out = stored(spark.range(0, rows, 1, 64), "few")
        assert 0 < len(out.inputFiles()) <= cores + rows * 8 // FILE_BYTES
        assert out.selectExpr("count(*)", "sum(id)").first() == (rows, rows * (rows - 1) // 2)


def test_components_in_one_task_and_in_rounds(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(900), draw.randrange(900)) for _ in range(500)] + [(2000 + k, 2001 + k) for k in range(300)] + [(5000, 5000)]
    frame = spark.createDataFrame(edges, "u long, v long")
    some, all_ = ({tuple(r) for r in components(frame, one_task=most).collect()} for most in (0, 1000))
    assert some == all_ and {(2000 + k, 2000) for k in range(301)} <= all_ and 5000 not in dict(all_)
    assert components(frame.where("u < 0")).collect() == []


def test_packed_keys_of_several_components():
    draw = np.random.default_rng(6)
    common = draw.integers(0, 1 << 64, 300, np.uint64, endpoint=False)
    rid = draw.permutation(3000).astype(np.int64) + (7 << 33)
    comp = np.where(draw.random(3000) < 0.9, rid, rid.min())
    keys = [np.concatenate([draw.integers(0, 1 << 64, 200, np.uint64), draw.choice(common, k % 3)]) for k in range(3000)]
    found, size = [], 0
    for part in range(3):
        packs = [row[1:] for a, b in ((0, 1000), (1000, 3000)) for row in simhash.pack_keys(keys[a:b], rid[a:b], comp[a:b], 3) if row[0] == part]
        size += sum(len(pa.compress(x, codec="lz4", asbytes=True)) for row in packs for x in row if x)
        found += zip(*(x.tolist() for x in simhash.parted_keys(packs)))
    assert size < 9 * sum(map(len, keys))  # a key was shuffled twice, at 17 bytes each
    holders = {}
    for own, r, c in zip(keys, rid.tolist(), comp.tolist()):
        for x in own.tolist():
            holders.setdefault(x >> 16, []).append((x >> 16, r, c))
    want = [row for rows in holders.values() if len({c for _, _, c in rows}) > 1 for row in rows]
    assert sorted(found) == sorted(want) and len(want) > 1000


def test_sketches_refuse_pairs_before_sets_are_joined(spark):
    draw = random.Random(12)
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(draw.choice(("x", w)) if draw.random() < k / 400 else w for w in base)) for k in range(40)]
    rows += [(40, ""), (41, None), (42, "a b c"), (43, "a b c d e f")]
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset() for _, t in rows for w in [(t or "").split()]]
    frame = spark.createDataFrame(rows, "rid long, text string")
    pairs = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows))]
    got = {tuple(r) for r in simhash._allowed(spark.createDataFrame(pairs, "u long, v long"), simhash._sketches(frame, 5), 0.8).collect()}
    want = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want <= got and 10 < len(want) and len(got - want) < (len(pairs) - len(want)) / 4


def test_forests_join_what_is_alike():
    draw, rows = np.random.default_rng(3), []
    base = draw.integers(0, 1 << 60, 300)
    for k in range(60):
        own = np.unique(np.concatenate([base[draw.permutation(300)[: 300 - 12 * (k % 3)]], draw.integers(0, 1 << 60, 12 * (k % 3))]))
        bits = np.bincount(own % simhash.SKETCH_BITS, minlength=simhash.SKETCH_BITS) & 1
        rows.append((k, k % 2, k, len(own), np.packbits(bits.astype(np.uint8)).tobytes(), None))
    frame = pd.DataFrame(rows, columns=["rid", "block", "comp", "n", "sketch", "refused"])
    one, three = simhash._forests(frame, 0.8, 1), simhash._forests(frame, 0.8, 3)
    assert len(one) == 59 and set(one) < set(three) and len(set(three)) == len(three)
    assert {x for pair in one for x in pair} == set(range(60))
    assert all((a - b) % 2 for a, b in three)  # two blocks: one against the other only


def test_pigeonring_masks_cover():
    masks, budgets = simhash.chain_keys(9, 2)
    full = (1 << 64) - 1
    for i in range(64):
        for j in range(i):
            diff = 1 << i | 1 << j
            assert any(diff & (m & full) == 0 and all(bin(diff & (x & full)).count("1") <= most for x, most in b)
                       for m, b in zip(masks, budgets))


@pytest.mark.parametrize("docs,shards", [
    ([(i, "hot" if i % 3 == 0 else f"p{i // 2}" if i % 3 == 1 else None if i % 5 == 0 else f"q{i % 50}") for i in range(300)], 7),
    ([(i, "same") for i in range(53)], 10), ([], 4), ([(1, "a"), (2, None), (None, ""), (1, "a")], 40)])
def test_sharding(spark, docs, shards):
    rows = sharding.balanced_shards(spark.createDataFrame(docs, SCHEMA), shards).collect()
    assert sorted(map(key, [(r.doc_id, r.size, r.text_crc32) for r in rows])) == sorted(
        map(key, [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs]))
    counts, slots = Counter(r.shard for r in rows), defaultdict(list)
    if docs:
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_keeps_groups(spark):
    docs = [(i, f"text {i // 3}" if i < 90 else f"alone {i}") for i in range(400)]
    placed = defaultdict(set)
    for r in sharding.balanced_shards(spark.createDataFrame(docs, SCHEMA), 8).collect():
        placed[docs[r.doc_id][1]].add(r.shard)
    assert all(len(s) == 1 for s in placed.values())


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = [(i, t) for i, t in docs_of(9)] + [(500, "It's WE'LL ²½ ªx 日本 İx Ünï <|endoftext|> a\x85b\xa0c"), (501, "word " * 300)]
    got = packing.packed_documents(spark.createDataFrame(docs, SCHEMA), capacity=64, partition_pieces=20).collect()
    want = []
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), 64)):
            part = ids[a : a + 64]
            want.append((i, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(w[3] for w in want)
    assert len(sequences) <= -(-total // 64) + 3


def test_bins_and_bounds():
    draw = random.Random(4)
    for _ in range(20):
        lengths = [draw.randint(1, 100) for _ in range(60)]
        kinds = Counter(lengths)
        bins = packing.best_fit_decreasing(list(kinds), list(kinds.values()), 100)
        assert Counter(x for b in bins for x in b) == kinds and all(sum(b) <= 100 for b in bins)
        low = packing.lower_bound(np.array(list(kinds)), np.array(list(kinds.values())), 100)
        assert low <= len(bins) + 1e-9 and low >= sum(lengths) / 100 - 1e-9


def test_decontamination(spark):
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本"]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(n))) for i, n in enumerate((20, 15, 13, 5, 1, 0))] + [(7, None), (None, "w1 w2 w3 w4 w5")]
    docs = [(i, " ".join([draw.choice(vocabulary + ["zz"] * 30) for _ in range(draw.randint(0, 40))] + (
        items[i % 8][1] or "").upper().replace(" ", ", ").split(" ") * (i % 3 == 0))) for i in range(60)] + [(60, None), (61, ""), (None, items[0][1])]
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = words.findall((t or "").translate(LOWER))
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add(i)
    want = []
    for i, t in docs:
        w = words.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        want.append((i, len(w), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 20, 500):
        got = decontaminate.contamination(d, b, max_broadcast_bytes=most)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    clean = [w[0] for w in want if not w[5]]
    assert sorted(map(str, (r.doc_id for r in decontaminate.decontaminated(d, b).collect()))) == sorted(map(str, clean))
    spans = decontaminate.decontaminated(d, b, mode="spans")
    assert spans.count() == len(docs)


def test_media_round_trip(spark):
    for raw in (b"", b"abc", bytes(range(256)) * 5, bytes(random.Random(0).randrange(256) for _ in range(5000))):
        avi = media.Avi(media.store_text(raw))
        assert media.read_samples(avi).tobytes() == media.pad(raw) and avi.fps == 24 and (avi.width, avi.height) == (128, 96)
    dark, light = np.full((30, media.SAMPLES), 20, np.uint8), np.full((30, media.SAMPLES), 220, np.uint8)
    assert media.shot_starts(np.concatenate([dark, light, dark])).tolist() == [0, 30, 60]
    docs = docs_of(1, 20)
    rows = {(r.doc_id, r.n_bytes): r for r in media.media_columns(spark.createDataFrame(docs, SCHEMA)).collect()}
    for i, t in docs:
        payload = media.pad((t or "").encode())
        r = rows[i, len((t or "").encode())]
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    with pytest.raises(ValueError):
        media.Avi(b"RIFFxxxxWAVE")
    assert media.clips(spark.createDataFrame(docs, SCHEMA)).count() >= len(docs)


def test_hidden_columns(spark):
    wide = spark.createDataFrame([(1, "a", 2)], "k1 int, text string, rid int")
    hidden = Hidden(wide)
    assert hidden.frame.columns == ["k0", "k1", "k2"] and hidden["text"] == "k1"
    back = hidden.restored(hidden.frame.withColumn("other", hidden.frame["k1"]))
    assert back.columns == wide.columns and tuple(back.first()) == (1, "a", 2)
