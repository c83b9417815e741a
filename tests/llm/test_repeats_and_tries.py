"""Periodic runs, prefix tries and best-fit packing against brute force and the library they must equal."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from weftline.llm import configurations, conversations, grammar, periodic, sequences
from weftline.llm import queries as registered
from weftline.llm.queues import SpillingQueue

# --- periodic runs


def plain_runs(words, exponent=4, shortest=6):
    """Every period tried on its own; a stretch is kept for its smallest."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def near_periodic(rnd):
    words = []
    letters = rnd.choice([1, 2, 2, 3, 20])
    for _ in range(rnd.randint(0, 6)):
        block = [rnd.randrange(letters) for _ in range(rnd.randint(1, 11))]
        words += block * rnd.choice([1, 1, 2, 4, 5, 9])
    return words * rnd.choice([1, 1, 1, 4])


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_those_of_every_period_tried(seed):
    rnd = random.Random(seed)
    texts = [near_periodic(rnd) for _ in range(40)]
    ids, starts, expected = [], [], []
    for k, words in enumerate(texts):
        if words:
            starts.append(len(ids))
            expected += [(len(ids) + s, len(ids) + s + n, q) for s, n, q in plain_runs(words)]
            ids += [1000 * k + w for w in words]
    found = grammar.runs(np.array(ids), np.array(starts), 4, 6)
    assert list(zip(*[x.tolist() for x in found], strict=True)) == expected


def test_the_grammar_spells_the_words_and_repeats_no_pair():
    rnd = random.Random(9)
    words = np.array([rnd.randrange(4) for _ in range(3000)])
    g = grammar.compress(words, np.array([0]))
    for r in range(len(g.size)):
        at = g.places[g.bounds[r] : g.bounds[r + 1]]
        assert len(at) >= 2
        spelt = {tuple(words[p : p + g.size[r]]) for p in at.tolist()}
        assert len(spelt) == 1
    tops = [tuple(words[a:b]) for a, b in zip(g.tops, [*g.tops[1:], len(words)], strict=True)]
    pairs = Counter(zip(tops[:-1], tops[1:], strict=True))
    # Three equal symbols in a row hold one pair, and its overlap.
    assert all(n < 2 or a == b for (a, b), n in pairs.items())


TEXTS = [
    (1, "a b a b a b a b c"),
    (2, "x\ty\nz" + " q" * 9000),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (None, "k " * 6),
    (1, "a b a b a b a b c"),
    (7, "eins zwei drei vier " * 4 + "é é é é"),
    (8, "no run here at all"),
]


def test_runs_of_odd_texts(docs):
    rows = periodic.find_runs(docs(TEXTS)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(k) for k, _ in TEXTS)
    by_id = {r.doc_id: r for r in rows}
    for key, text in TEXTS:
        words = (text or "").encode().split()
        runs = plain_runs(words) if key != 2 else [(3, 9000, 1)]
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        assert [tuple(x) for x in by_id[key].runs] == runs
        assert by_id[key].collapsed.encode() == b" ".join(kept)
    assert periodic.find_runs(docs([])).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs(TEXTS), exponent=3)


def test_planted_runs_and_digests_follow_the_contract(spark, docs):
    rnd = random.Random(4)
    rows = [(k, " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 60)))) for k in range(400)]
    found = {r.doc_id: r for r in periodic.digests(periodic.find_runs(periodic.with_planted_runs(docs(rows)))).collect()}
    planted = 0
    for key, text in rows:
        words = text.encode().split()
        n, h = len(words), zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
        expected = (key, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4))
        expected += tuple(hashlib.sha256(x).hexdigest() for x in (told.encode(), b" ".join(kept)))
        assert tuple(found[key]) == expected
    assert planted > 10


# --- the trie of conversations


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(k)))
        up = min(nodes[k[:-1]]) if k else None
        out.append((min(members), len(k), up, len(members), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(rnd, n, longest=9):
    rows = []
    for c in range(n):
        same = rnd.random() < 0.4
        for t in range(rnd.randint(1, longest)):
            text = f"turn {t}" if same else rnd.choice(["hello", "grüße", "", None])
            rows.append((c, rnd.choice([t, t, None]) if t == 0 else t, rnd.choice(["user", "assistant", None]) if not same else "user", text))
    return rows


@pytest.fixture
def conversation_rows(spark):
    def build(rows):
        full = [(*r, "x", 5, None) for r in rows]
        schema = "conv_id long, turn long, role string, text string, depth string, a int, content string"
        return spark.createDataFrame(full, schema).repartition(4)

    return build


@pytest.mark.parametrize("most", [None, 1, 12])
def test_the_trie_equals_plain_prefixes(conversation_rows, monkeypatch, most):
    if most:
        # So small a bound puts several levels of nodes above all shards.
        whole = conversations.prefix_trie
        monkeypatch.setattr(conversations, "prefix_trie", lambda walked, convs: whole(walked, convs, most=most))
    rows = talks(random.Random(most or 0), 60)
    rows += [(None, 1, "user", "nobody's"), (900, 3, "user", "long " * 2000), (901, 0, None, None), (-3, 1, "user", "turn 0")]
    rows += [rows[5]] * 3
    got = conversations.trie_report(conversation_rows(rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_trie(rows)


def test_a_trie_of_nothing_is_empty_and_one_of_turnless_conversations_is_a_root(conversation_rows):
    assert conversations.trie_report(conversation_rows([])).count() == 0
    # Without its base, a conversation that takes over more turns than it has is left without any.
    alone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    (root,) = conversations.trie_report(conversation_rows([(alone, 0, "user", "gone")])).collect()
    assert tuple(root) == (alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())


def test_long_lists_of_ends_are_hashed_block_by_block(conversation_rows, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 7)
    batches = [pa.record_batch([[1] * 40, [2] * 40, [3] * 40, list(range(5, 45))], names=["depth", "a", "b", "conv_id"])]
    blocks = list(conversations._blocks(iter(batches)))
    assert sum(b.num_rows for b in blocks) == 6
    hashed = [r for b in conversations._hashed(iter(blocks)) for r in b.to_pylist()]
    assert [r["ends_sha256"] for r in hashed] == [hashlib.sha256(",".join(map(str, range(5, 45))).encode()).hexdigest()]


def test_a_hot_conversation_is_numbered_in_chunks(spark, conversation_rows, monkeypatch):
    from weftline.operators import spread

    monkeypatch.setattr(spread, "MOST", 40)
    rows = [(5, t, "user", f"t{t % 7}") for t in range(150)] + talks(random.Random(2), 20, longest=6)[40:]
    rows = [r for r in rows if r[0] != 5 or r[3][:1] == "t"]
    got = conversations.trie_report(conversation_rows(rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_trie(rows)


@pytest.mark.parametrize("held", [3, 50, 10_000])
def test_the_queue_spills_and_stays_in_order(held):
    rnd = random.Random(held)
    queue, model, out, expected = SpillingQueue(held), [], [], []
    for _ in range(3000):
        if model and rnd.random() < 0.45:
            assert queue.peek() == min(model)
            out.append(queue.pop())
            model.remove(min(model))
            expected.append(out[-1])
        else:
            message = (rnd.randrange(200), rnd.randrange(1000))
            queue.push(message)
            model.append(message)
    while queue.peek() is not None:
        out.append(queue.pop())
    assert out[len(expected) :] == sorted(model)


# --- best-fit packing


def packed_whole(plan, counts):
    """Replays a plan: every piece once, no gap, nothing over the capacity. Gives the number of sequences."""
    seen, filled = Counter(), defaultdict(list)
    for length, first, count, sequence, offset in plan.arrays().T.tolist():
        assert first == seen[length]
        seen[length] += count
        for i in range(count):
            filled[sequence + i].append((offset, length))
    assert all(seen[n] == c for n, c in enumerate(counts) if n)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= plan.capacity
    assert sorted(filled) == list(range(plan.sequences))
    return plan.sequences


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        capacity = rnd.choice([1, 2, 7, 16, 64, 100])
        counts = np.array([0] + [rnd.choice([0, 0, 1, 2, 9, 40]) for _ in range(capacity)])
        packed_whole(configurations.pack(counts, capacity, groups=rnd.choice([1, 3, 20])), counts.tolist())


def best_fit(counts, capacity):
    rooms = Counter()
    opened = 0
    for length in range(capacity, 0, -1):
        for _ in range(int(counts[length])):
            room = min((r for r, n in rooms.items() if n and r >= length), default=None)
            if room is None:
                opened += 1
                room = capacity
            else:
                rooms[room] -= 1
            rooms[room - length] += 1
    return opened


def test_configurations_save_sequences_that_best_fit_alone_needs():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(225, 450, 4000), minlength=1025)
    needed = packed_whole(configurations.pack(counts, 1024), counts.tolist())
    least = -(-int((np.arange(1025) * counts).sum()) // 1024)
    assert needed < best_fit(counts, 1024) * 0.97
    assert needed <= 1.02 * least


def test_many_small_pieces_leave_no_room():
    rng = np.random.default_rng(4)
    counts = np.bincount(np.minimum(1024, rng.lognormal(4.5, 1, 20000).astype(int) + 1), minlength=1025)
    least = -(-int((np.arange(1025) * counts).sum()) // 1024)
    assert packed_whole(configurations.pack(counts, 1024), counts.tolist()) <= least * 1.001 + 1


PIECES = [
    (1, "The quick brown fox."),
    (2, None),
    (3, ""),
    (None, "no id"),
    (1, "The quick brown fox."),
    (4, "word <|endoftext|> INSIDE <|ENDOFTEXT|> It's J̌ ño  Été, Müller. İ 中文"),
    (5, "lorem ipsum " * 900),
    (6, "supercalifragilistic" * 400),
    *[(k, "a few words " * (k % 9)) for k in range(10, 60)],
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_packed_pieces_are_the_librarys_ids_without_gaps(docs, name):
    path = public_tokenizers.path(name)
    library = tokenizers.Tokenizer.from_file(path)
    packed = sequences.pack(docs(PIECES), path, capacity=64, end=1, with_ids=True).cache()
    rows = packed.collect()
    expected = Counter()
    for key, text in PIECES:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 64):
            part = np.array(ids[at : at + 64], "<u4").tobytes()
            expected[(key, at // 64, at, len(part) // 4, zlib.crc32(part), part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == expected
    inside = defaultdict(list)
    for r in rows:
        inside[r.sequence_id].append((r.offset, bytes(r.ids)))
    whole = {k: b"".join(ids for _, ids in sorted(v)) for k, v in inside.items()}
    for v in inside.values():
        at = 0
        for offset, ids in sorted(v):
            assert offset == at
            at += len(ids) // 4
        assert at <= 64
    assert {r.sequence_id: bytes(r.ids) for r in sequences.filled(packed).collect()} == whole
    tokens = sum(r.length for r in rows)
    assert len(whole) <= 1.05 * -(-tokens // 64) + 1


def test_packing_nothing(docs):
    assert sequences.pack(docs([]), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        sequences.pack(docs(PIECES), public_tokenizers.path("word_bpe_49k.json"), capacity=0)


def test_a_hot_length_is_numbered_in_parts(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 1).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"),
    )
    counts = np.zeros(65, np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    numbered = sequences._numbered(rows, counts).collect()
    assert len({r["part"] for r in numbered if r["length"] == 7}) > 500
    for length in range(65):
        assert sorted(r["number"] for r in numbered if r["length"] == length) == list(range(int(counts[length])))


def test_the_queries_run_over_whole_tables(spark):
    small = "/root/testdata/sf0.001"
    assert {"op11_periodic_runs", "op12_prefix_trie", "op13_best_fit_packing"} <= set(registered.QUERIES)
    found = registered.QUERIES["op11_periodic_runs"](spark, small)
    assert found.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = registered.QUERIES["op12_prefix_trie"](spark, small).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_trie(rows)
