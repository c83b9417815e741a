"""Token counts, pieces, language, licenses."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from weftline.llm import language, licenses, sentencepieces, token_counts
from weftline.session import scratch_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None,
    "",
    " ",
    "a",
    "  two  spaces ",
    "tab\t\n\n end \n",
    "don't we'll 3rd 12 34 5.6",
    "été naïve Straße 漢字 😀 ​x",
    "<|endoftext|> and <s> text </s>",
    "▁ literal",
    "x" * 3000,
    "word " * 5000,
    "a   b   c\r\n d",
    "nul \0 byte",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BPE)


def test_counts_equal_the_library(spark, docs, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a"), (1, "a")]
    cache = scratch_path(spark, "cache")
    found = token_counts.count_tokens(docs(rows), BPE, cache).collect()
    want = sorted((repr(k), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows)
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in found)


def test_cache_encodes_only_misses(spark, docs):
    cache = scratch_path(spark, "cache")
    token_counts.count_tokens(docs([(1, "one"), (2, "one"), (3, "two")]), BPE, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    token_counts.count_tokens(docs([(4, "two"), (5, "three")]), BPE, cache).collect()
    assert spark.read.parquet(cache).count() == 3
    # A count that is stored is believed: nothing was encoded again.
    digest = token_counts.tokenizer_digest(BPE)
    planted = spark.createDataFrame([(bytearray(hashlib.sha256(b"four").digest()), digest, 99)], token_counts.CACHE_SCHEMA)
    planted.write.mode("append").parquet(cache)
    assert token_counts.count_tokens(docs([(6, "four")]), BPE, cache).first().n_tokens == 99
    # Another tokenizer has counts of its own.
    other = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.count_tokens(docs([(6, "four")]), other, cache).first().n_tokens != 99


def test_counts_of_an_empty_table(spark, docs):
    assert token_counts.count_tokens(docs([(1, "x")]).where("false"), BPE, scratch_path(spark, "cache")).count() == 0


_TEXT = st.text(alphabet=st.sampled_from(list("ab'sltre 1\n\t.,-_éß漢😀 ▁")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(_TEXT)
def test_additive_counts(text):
    counter = token_counts._counter(BPE)
    assert counter.counts([text]) == counter.whole([text])


@settings(max_examples=300, deadline=None)
@given(_TEXT)
def test_pieces_equal_the_library_and_cover_the_text(text):
    one = sentencepieces.encoder(PIECES)
    (ids, said), = one.ids([text])
    assert ids.tolist() == one.library.encode(text) and said == ",".join(map(str, one.library.encode(text)))
    spans = one.spans(text, ids)
    source = text.encode()
    # Neighbouring pieces touch, and together they are the text.
    assert b"".join(source[b:e] for b, e in spans) == source
    for piece, (begin, end) in zip(one.library.encode(text, out_type=str), spans.tolist(), strict=True):
        if not piece.startswith("<0x"):
            assert source[begin:end].decode().replace(" ", "▁") == (piece if begin or not piece.startswith("▁") or source.startswith(b" ") and end > begin and piece == "▁" else piece[1:]) or begin == 0


def test_digests_and_lists(spark, docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a"), (1, "a")]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def want(t):
        ids = sp.encode(t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))

    found = sentencepieces.digest_pieces(docs(rows), PIECES).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(
        (repr(k), *want(t)) for k, t in rows
    )
    assert sum(r.n_bytes for r in found) == sum(len((t or "").encode()) for _, t in rows)
    encoded = sentencepieces.encode(docs(rows), PIECES)
    texts = {r.doc_id: r.text for r in sentencepieces.decode(encoded.where("doc_id > 1"), PIECES).collect()}
    assert texts == {k: sp.decode(sp.encode(t or "")) for k, t in rows if k is not None and k > 1}
    assert sentencepieces.encode(docs(rows).where("false"), PIECES).count() == 0


def _trie(entries: dict[str, str]) -> bytes:
    """A character map as the format lays it out: one unit for each state, in the fewest steps that serve a test."""
    children: dict[bytes, set[int]] = {b"": set()}
    values, replaced = {}, b""
    for source, target in sorted(entries.items()):
        data = source.encode()
        values[data] = len(replaced)
        replaced += target.encode() + b"\0"
        for i in range(len(data)):
            children.setdefault(data[:i], set()).add(data[i])
            children.setdefault(data[: i + 1], set())
    units, place, free = [0] * 4096, {b"": 0}, 256
    for node in sorted(children, key=len):
        # A block of 256 places for each node's children; its value stands at the block's start.
        base = free
        free += 256
        label = node[-1] if node else 0
        offset = base ^ place[node]
        units[place[node]] = label | (256 if node in values else 0) | offset << 10
        if node in values:
            units[base] = values[node] | 1 << 31
        for byte in children[node]:
            place[node + bytes([byte])] = base ^ byte
    import struct

    used = struct.pack(f"<{free}I", *units[:free])
    return struct.pack("<I", len(used)) + used + replaced


def test_longest_mapped_prefix_keeps_the_source():
    spec = model_pb2.NormalizerSpec(add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    spec.precompiled_charsmap = _trie({"A": "a", "AB": "X", "ﬁ": "fi", "\t": " "})
    normalise = sentencepieces.Normaliser(spec, False)
    source = "  ABA\t\tﬁA ".encode()
    text, origin = normalise(source)
    assert text.decode() == "▁Xa▁fia"
    assert origin.tolist() == [2, 2, 2, 2, 4, 5, 5, 5, 7, 7, 10, 11]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    filters = language.learn(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    found = language.identify(docs, filters).join(docs, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_language_edge_cases(spark, docs):
    taught = [(i, w * 30, lang) for i, (w, lang) in enumerate([("the cat sat ", "en"), ("le chat noir ", "fr")] * 20)]
    taught += [(None, "das", "de"), (99, None, "es"), (98, "x", None)]
    table = spark.createDataFrame(taught, "doc_id long, text string, lang string")
    filters = language.learn(table, F.lit(True))
    assert filters.languages == ("en", "fr")
    rows = [(1, None), (2, ""), (3, "12 !? …"), (4, "THE CAT"), (5, "le chat"), (None, "the cat"), (4, "THE CAT"), (6, "жук"), (7, "the " * 9000)]
    found = sorted(((repr(r.doc_id), r.lang_pred) for r in language.identify(docs(rows), filters).collect()))
    assert found == sorted(
        [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("5", "fr"), ("None", "en"), ("4", "en"), ("6", "en"), ("7", "en")]
    )
    assert sorted(repr(r.doc_id) for r in language.keep_identified(docs(rows), filters).collect()) == sorted(["4", "5", "None", "4", "7"])
    assert language.keep_identified(docs(rows), filters).columns == docs(rows).columns
    assert language.identify(docs(rows).where("false"), filters).count() == 0
    none = language.learn(table.where("false"), F.lit(True))
    assert {r.lang_pred for r in language.identify(docs(rows), none).collect()} == {"und"}


def test_sliced_filters_return_all_holders():
    import numpy as np

    codes = np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    languages = [f"l{i:02}" for i in range(12)]
    owner = np.concatenate([np.full(len(codes), i) for i in range(12)])
    held = [codes[i::3] if i < 3 else codes[i * 100 : i * 100 + 100] for i in range(12)]
    owner = np.concatenate([np.full(len(h), i) for i, h in enumerate(held)])
    filters = language.Filters.build(languages, np.concatenate(held), owner)
    for i, h in enumerate(held):
        assert (filters.holders(h) >> np.uint16(i) & 1).all()
        counts = filters.counts(h)
        assert abs(counts[i] - len(h)) <= 1


def test_licenses(spark, docs):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, f"Some text here.\n{apache}\nMore text."),
        (2, "Licensed under the\nApache License, Version 3.0."),
        (3, "Licensed under the MIT License. Licensed under CC BY 4.0."),
        (4, None),
        (5, ""),
        (None, apache),
        (6, licenses.NOTICES[0][1].replace("Software", "Program", 1).upper()),
        (7, "nothing with a license in it " * 2000),
        (8, apache),
        (8, apache),
        (9, "We got permission to print this."),
    ]
    found = licenses.scan(docs(rows)).collect()
    said = sorted((repr(r.doc_id), r.place, r.license, r.differing) for r in found)
    assert said == sorted(
        [("1", 0, "Apache-2.0", 0), ("3", 0, "MIT", 0), ("3", 1, "CC-BY-4.0", 0), ("None", 0, "Apache-2.0", 0)]
        + [("6", 0, "MIT", 1), ("8", 0, "Apache-2.0", 0), ("8", 0, "Apache-2.0", 0)]
    )
    one = next(r for r in found if r.doc_id == 1)
    assert rows[0][1][one.begin : one.end] == apache[:-1]
    assert licenses.scan(docs(rows).where("false")).count() == 0


@pytest.mark.parametrize("at", range(len(licenses.TEMPLATES)))
def test_each_template_is_found(at):
    name, text = licenses.TEMPLATES[at]
    scanner = licenses._scanner(licenses.TEMPLATES)
    found = list(scanner.scan(f"Qwerty uiop asdf. {text.replace(' ', chr(10), 3)} Zxcvb nmlk jhgf."))
    assert [m.license for _, _, m in found] == [name]


def found_in(text):
    return [m.license for _, _, m in licenses._scanner(licenses.TEMPLATES).scan(text)]


def test_a_license_ranked_behind_many_others_is_found():
    said = ["Mozilla Public License, Version 2.0", "CC BY 4.0", "GNU General Public License, version 3"]
    text = f"Licensed under the {said[0]}. This project is licensed under {said[1]}. Released under the {said[2]}."
    assert found_in(text) == ["MPL-2.0", "CC-BY-4.0", "GPL-3.0"]


def test_a_license_is_found_whatever_surrounds_it():
    short = licenses.TEMPLATES[len(licenses.NOTICES) :]
    order = random.Random(1).sample(range(len(short)), len(short))
    assert found_in(" ".join(short[i][1] for i in order)) == [short[i][0] for i in order]
    known = sorted({w for _, t in licenses.TEMPLATES for w in licenses.words(t)})
    other = " ".join(random.Random(2).choices(known, k=500))
    for name, text in licenses.TEMPLATES:
        assert found_in(f"{text} {other}.") == [name]


SENTENCES = [
    ("The jQuery plugin by John Smith is released under the MIT License.", ["MIT"]),
    ("Foo is a small parser library written by Jane Doe, released under the MIT License, as is bar.", ["MIT"]),
    ("Except where otherwise noted, content on this site is licensed under CC BY 4.0.", ["CC-BY-4.0"]),
    ("Released under (CC BY 4.0)", ["CC-BY-4.0"]),
    (licenses.NOTICES[0][1].replace("to deal in the Software", "to\nJohn Smith Jane Doe, deal in Software"), ["MIT"]),
    ("The jQuery plugin by John Smith has a license.", []),
]


def test_statements_inside_longer_sentences(spark, docs):
    found = licenses.scan(docs([(i, text) for i, (text, _) in enumerate(SENTENCES)])).collect()
    assert sorted((r.doc_id, r.place, r.license) for r in found) == [
        (i, place, name) for i, (_, names) in enumerate(SENTENCES) for place, name in enumerate(names)
    ]


def test_no_allowed_edits_take_all_signals_away():
    for _, text in licenses.TEMPLATES:
        said = licenses.words(text)
        assert len(re.findall("|".join(licenses.SIGNALS), " ".join(said))) > int(licenses.TOLERANCE * len(said))


def test_one_text_repeats_a_statement_many_times(spark, docs):
    rows = [(1, "Licensed under the MIT License.\n" * 6000), (2, licenses.NOTICES[2][1] * 300), (3, "This work is licensed under CC BY-NC-SA 4.0. " * 2000)]
    found = licenses.scan(docs(rows)).groupBy("doc_id", "license").count().collect()
    assert sorted(tuple(r) for r in found) == [(1, "MIT", 6000), (2, "GPL-3.0-or-later", 300), (3, "CC-BY-NC-SA-4.0", 2000)]


def test_compression_ranks_templates_before_words_confirm_them(monkeypatch):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    steps = []
    compressed, ranked, fit = type(scanner.alone).compress, scanner.ranked, scanner.fit
    monkeypatch.setattr(scanner, "ranked", lambda block: steps.append(("rank", ranked(block))) or steps[-1][1])
    monkeypatch.setattr(scanner, "fit", lambda i, said: steps.append(("fit", i)) or fit(i, said))
    text = "word " * 900 + f"{licenses.NOTICES[1][1]} Licensed under the MIT License. " + "word " * 900
    assert [m.license for _, _, m in scanner.scan(text)] == ["Apache-2.0", "MIT"]
    assert steps[0][0] == "rank"
    # The notice, all of the block but one statement, saves most; each block's templates are confirmed down its ranking.
    rankings = [s for kind, s in steps if kind == "rank"]
    assert all(sorted(r) == list(range(len(licenses.TEMPLATES))) for r in rankings) and 1 in {r[0] for r in rankings}
    tried = [s for kind, s in steps[1 : next((n for n, s in enumerate(steps[1:], 1) if s[0] == "rank"), None)] if kind == "fit"]
    assert [rankings[0].index(i) for i in tried] == sorted(rankings[0].index(i) for i in tried) and tried
    data = " ".join(licenses.words(licenses.NOTICES[1][1])).encode()
    assert len(compressed(scanner.given[1], data)) < len(compressed(scanner.alone, data))


@pytest.mark.parametrize("before", [0, 150, 190, 199, 200, 250, 399])
def test_blocks_lose_no_wording_at_their_edges(before):
    name, text = licenses.NOTICES[0]
    assert found_in("word " * before + text + " word" * 300 + " " + text) == [name, name]


def every_fit(scanner, said, offset=0):
    """All templates against all words left, the best taken first."""
    fits = []
    for i, template in enumerate(scanner.words):
        begin, end, differing = licenses.closest(template, said)
        if differing <= scanner.allowed[i]:
            saved = scanner.saved(i, " ".join(said[begin:end]))
            fits.append((differing - len(template), differing, -saved, i, begin, end))
    if not fits:
        return []
    _, differing, _, i, begin, end = min(fits)
    left, right = every_fit(scanner, said[:begin], offset), every_fit(scanner, said[end:], offset + end)
    return [*left, (i, begin + offset, end + offset, differing), *right]


@pytest.mark.parametrize("seed", range(40))
def test_scan_equals_trying_every_template_everywhere(seed):
    chance, scanner = random.Random(seed), licenses._scanner(licenses.TEMPLATES)
    known = [w for t in scanner.words for w in t]
    said = []
    for _ in range(chance.randint(1, 5)):
        i = chance.randrange(len(scanner.words)) if chance.random() < 0.6 else chance.randrange(len(licenses.NOTICES))
        wording = list(scanner.words[i])
        for _ in range(chance.randint(0, scanner.allowed[i] + 1)):
            at = chance.randrange(len(wording))
            wording[at : at + chance.randint(0, 1)] = chance.choices(["other", *known], k=chance.randint(0, 1))
        cut = chance.choice([0, 0, 0, 1, 2])
        said += wording[: len(wording) - cut] + chance.choices(["other", *known], k=chance.choice([0, 0, 1, 8]))
    found = [(m.template, m.begin, m.end, m.differing) for _, _, m in scanner.scan(" ".join(said))]
    assert found == every_fit(scanner, licenses.words(" ".join(said)))


def test_closest_part():
    assert licenses.closest("a b c".split(), "x a b c y".split()) == (1, 4, 0)
    assert licenses.closest("a b c".split(), "x a q c y".split()) == (1, 4, 1)
    assert licenses.closest("a b c".split(), "a c".split()) == (0, 2, 1)


def test_license_of_every_statement_in_the_table(spark):
    """Brute force: every line that equals a template word for word is found, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by_words = {tuple(licenses.words(t)): n for n, t in licenses.TEMPLATES}
    want = sorted(
        (r.doc_id, by_words[tuple(licenses.words(line))])
        for r in docs.select("doc_id", "text").collect()
        for line in (r.text or "").split("\n")
        if tuple(licenses.words(line)) in by_words
    )
    assert sorted((r.doc_id, r.license) for r in licenses.scan(docs).collect()) == want and want
