"""Small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import re
import struct
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm import bpe_automaton, cotraining, line_chunks, order_minhash, perspective, quality_rules, repair_binary, token_fst
from loomwright.llm.base import shared_dir

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    "", None, " \n\t ", "I'm sure it isn't 12% of ½ the ΣΟΦΟΣ café.", "a<|endoftext|>b <|startoftext|> c", "x" * 3000, "日本語 テキスト 😀", "tab\there\x1csep nbsp  two  blanks\n\nlines \n end ",
    "the cat sat on the mat the cat sat on the mat the cat sat", "one | two | three\none | two | three\nother line\n\n\n", LONG, "the cat sat on the mat the cat sat on the mat the cat sat",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s"), (None, "no id at all", "de", None)], "doc_id long, text string, lang string, n_tokens string")


def test_bpe_round_trip_matches_library(docs):
    lib = Tokenizer.from_file(WORD_BPE)
    rows = bpe_automaton.decode(bpe_automaton.encode(docs, WORD_BPE).withColumnRenamed("decoded", "at_once"), WORD_BPE).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == ids
        assert r.decoded == r.at_once == lib.decode(ids, skip_special_tokens=False)


def test_automaton_accepts_only_correct_tokenizations():
    merges = [("a", "b"), ("a", "ab"), ("b", "b"), ("ab", "bb"), ("a", "a")]
    vocab = {t: i for i, t in enumerate(["a", "b", "ab", "aab", "bb", "abbb", "aa"])}
    automaton = bpe_automaton.MergeAutomaton(vocab, merges)

    def by_rank(word):
        parts = list(word)
        for u, v in merges:
            i = 0
            while i + 1 < len(parts):
                if parts[i] == u and parts[i + 1] == v:
                    parts[i : i + 2] = [u + v]
                i += 1
        return [vocab[p] for p in parts]

    for n in range(1, 10):
        for k in range(1 << n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert automaton.encode(word) == by_rank(word), word


def test_bpe_keeps_common_words_and_little_else(monkeypatch):
    """Common words are cut once, however many rare ones come between; the automaton holds no table of what it has walked."""
    import random
    import tracemalloc

    draw = random.Random(5)
    rare = lambda: "".join(draw.choice("etaoinsrhldcumfpgwybvkxjqz") for _ in range(12))
    c = bpe_automaton.WordCodec(open(WORD_BPE, "rb").read())
    tracemalloc.start()
    c.encode(" ".join(rare() for _ in range(40_000)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 28 << 20
    monkeypatch.setattr(bpe_automaton, "MEMO", 100)
    cut, split = Counter(), c.split
    monkeypatch.setattr(c, "split", lambda w: cut.update([w]) or split(w))
    common = [f"{a}{b}q" for a in "abcd" for b in "abcde"]
    for _ in range(60):
        c.encode(" ".join([*common, *(rare() for _ in range(40))]))
    assert max(cut[w] for w in common) == 1


def test_bpe_carries_the_named_columns(docs):
    got = bpe_automaton.encode(docs, WORD_BPE, carry=["doc_id"])
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    want = bpe_automaton.encode(docs, WORD_BPE)
    key = lambda r: (r.doc_id or -1, bytes(r.ids))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_token_counts_match_library_for_any_chunk(docs):
    lib = Tokenizer.from_file(WORD_BPE)
    for r in token_fst.token_counts(docs, WORD_BPE, limit=20).collect():
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 20)
    counter = token_fst.counter(open(WORD_BPE, "rb").read())
    for t in TEXTS:
        if t and len(t) < 4000:
            assert {counter.count(t, k) for k in (1, 3, 50)} == {len(lib.encode(t, add_special_tokens=False).ids)}


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert token_fst.token_counts(none, WORD_BPE).count() == bpe_automaton.encode(none, WORD_BPE).count() == 0
    assert order_minhash.near_duplicates(none).count() == line_chunks.dedup_lines(none).count() == 0
    assert quality_rules.judge(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    path = f"{shared_dir(spark)}/none-{uuid.uuid4().hex}"
    repair_binary.write_ids(none, BYTE_BPE, path)
    assert repair_binary.read_ids(spark, path).count() == 0


def test_binary_output_round_trip(spark, docs):
    lib, path = Tokenizer.from_file(BYTE_BPE), f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    repair_binary.write_ids(docs, BYTE_BPE, path, shard_ids=5000)
    got = repair_binary.read_ids(spark, path).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    at = 0
    for (k, t), r in zip(sorted(((d.doc_id, d.text) for d in docs.collect()), key=key), sorted(got, key=lambda r: r.start), strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        raw = np.array(ids, "<u4").tobytes()
        assert (r.key, r.start, r.n_tokens, bytes(r.ids), r.crc32) == (k, at, len(ids), raw, zlib.crc32(raw))
        at += len(ids)
    for row in spark.read.parquet(path).collect():
        row = row.asDict()
        for k, d in enumerate(repair_binary.decode_shard(row)):
            assert (repair_binary.read_document(row, k) == d).all()


@pytest.mark.parametrize("least", [2, 16])
def test_repair_compresses_and_expands(least):
    rng = np.random.default_rng(1)
    cases = [np.tile(rng.integers(0, 50, 40), 60), rng.integers(0, 3, 5000), np.zeros(3001, int), np.arange(50), np.array([7]), np.concatenate([rng.integers(0, 50, 30), np.tile([1, 2, 1], 300)])]
    for ids in (c.astype(np.uint32) for c in cases):
        last = np.zeros(len(ids), bool)
        last[99::100] = last[-1] = True
        symbols, ends, rules = repair_binary.repair(ids, last, 50, least=least)
        assert (repair_binary.expand(symbols, rules, 50) == ids).all() and ends.sum() == last.sum()
        counts = Counter((a, b) for a, b, e in zip(symbols.tolist(), symbols[1:].tolist(), ends) if not e)
        assert max(counts.values(), default=0) < least  # it ends only when no pair is frequent
        lengths = repair_binary.rule_lengths(rules, 50)
        assert all(len(repair_binary.expand(np.array([50 + k]), rules, 50)) == n for k, n in enumerate(lengths))
        row = repair_binary.shard_row(0, 0, 0, list(range(int(last.sum()))), ids, np.flatnonzero(last) + 1, 50)
        for start, count in ((0, 1), (5, 17), (99, 2), (len(ids) - 1, 9), (len(ids), 3), (0, len(ids))):
            assert repair_binary.read_ids_at(row, start, count).tolist() == ids[start : start + count].tolist()
    assert len(repair_binary.repair(cases[0].astype(np.uint32), np.arange(2400) % 100 == 99, 50, least=2)[0]) < 2400 / 4


def test_every_code_point_as_the_library_has_it():
    """Letters that Python's tables don't know, and a sample of all planes, alone and between neighbours."""
    import unicodedata

    import regex

    lib, c = Tokenizer.from_file(WORD_BPE), bpe_automaton.codec(open(WORD_BPE, "rb").read())
    rng = np.random.default_rng(8)
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    odd = [p for p in points if unicodedata.category(chr(p)) == "Cn" and regex.match(r"[\p{L}\p{N}\p{M}]", chr(p))]
    some = [*rng.choice(odd, min(2500, len(odd)), replace=False), 0x1C89, 0xA7CB, 0xA7CC, 0x10D50, 0xAB6D, 0x18D19, *rng.choice(points, 4000, replace=False), *range(0x300, 0x370), *rng.choice(0x20000, 3000)]
    some = [chr(p) for p in some if not 0xD800 <= p < 0xE000]
    texts = ["".join(some[i : i + 4]) for i in range(0, len(some), 4)] + [f"a{x}b 1{x}' {x}" for x in some]
    counter = token_fst.counter(open(WORD_BPE, "rb").read())
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        n, ids = c.encode(t)
        assert list(struct.unpack(f"<{n}I", ids)) == e.ids, ascii(t)
        assert counter.count(t) == n and c.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_queries_of_tokens_against_the_library(spark, sf):
    """op5, op8 and op9 as registered, over their whole table."""
    from loomwright.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    words, bytes_ = Tokenizer.from_file(WORD_BPE), Tokenizer.from_file(BYTE_BPE)
    op5 = {r.doc_id: r for r in QUERIES["op5_token_counts"](spark, sf).collect()}
    op8 = {r.doc_id: r for r in QUERIES["op8_binary_output"](spark, sf).collect()}
    op9 = {r.doc_id: r for r in QUERIES["op9_bpe"](spark, sf).collect()}
    assert len(rows) == len(op5) == len(op8) == len(op9)
    at = 0
    for r in rows:
        t = r.text or ""
        ids = words.encode(t, add_special_tokens=False).ids
        assert (op5[r.doc_id].n_bytes, op5[r.doc_id].n_tokens, op5[r.doc_id].over_limit) == (len(t.encode()), len(ids), len(ids) > 2048)
        raw, text = np.array(ids, "<u4").tobytes(), words.decode(ids, skip_special_tokens=False)
        assert (op9[r.doc_id].n_tokens, op9[r.doc_id].ids_sha256, op9[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        raw = np.array(bytes_.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert (op8[r.doc_id].start, op8[r.doc_id].n_tokens, op8[r.doc_id].ids_crc32) == (at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4


def brute_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_base_counts(docs):
    for r in quality_rules.base_counts(docs).collect():
        want = brute_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text[:50]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_binomial_tail_and_cutoffs(spark):
    from math import comb

    cases = [(k, n, p) for n in (1, 7, 40, 300) for k in (0, 1, 3, n) if k <= n for p in (0.01, 0.2)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.at_most(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
        assert got == pytest.approx(want, rel=1e-9)
    # 1,000 good documents in one stratum: 2 have 30 symbols a thousand, the rest none; 20 in another can prove nothing
    rows = [("en", 100, 1000, 30 if i < 2 else 0, 0, 10, 0, 0) for i in range(1000)] + [(None, 100, 1000, 0, 0, 10, 0, 0)] * 20
    cut = {r.stratum: r for r in quality_rules.select_cutoffs(spark.createDataFrame(rows, "lang string, n_words long, word_chars long, n_symbols long, n_capitals long, n_lines long, n_dup_lines long, n_repeat_words long"), "lang", risk=0.04).collect()}
    assert cut["en"].c_symbols == 5 and cut["en"].c_repeats == 5 and cut[None].c_symbols is None


def test_line_dedup_removes_later_copies(spark):
    passage = "\n".join(f"shared line number {i} with several words in it" for i in range(40))
    own = lambda k: "\n".join(f"document {k} says on line {i} something of its own" for i in range(25))
    rows = [(1, own(1) + "\n" + passage + "\n" + own(11)), (2, own(2) + "\n" + passage), (3, own(3)), (4, None), (5, ""), (6, "one line"), (2, own(2) + "\n" + passage), (None, passage)]
    out = line_chunks.dedup_lines(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, N_Removed_Lines string")).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(out) == len(rows)
    assert by[1][0].text == rows[0][1] and by[3][0].text == rows[2][1] and by[4][0].text is None and by[5][0].text == "" and by[6][0].text == "one line"
    assert {r.text for r in by[2]} == {by[2][0].text} and by[2][0].text.startswith(own(2)[:-60]) and by[2][0].n_removed_lines >= 20
    assert by[None][0].n_removed_lines >= 20
    for r in out:  # what is left is a subsequence of the lines
        if r.text:
            it = iter(dict((x, None) for x in [next(t for i, t in rows if i == r.doc_id)]).popitem()[0].split("\n"))
            assert all(line in it for line in r.text.split("\n")) or r.text == ""


def brute_line_dedup(rows, most=50):
    """Texts by row, of distinct ids in order: lines of windows of over most words that an earlier place holds go."""
    seen, out = {}, []
    for i, (_, t) in enumerate(rows):
        lines = t.split("\n")
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if lines[a].split() and lines[b - 1].split() and sum(len(x.split()) for x in lines[a:b]) > most:
                    doc, at = seen.setdefault("\n".join(lines[a:b]), (i, a))
                    if (doc, at) != (i, a):
                        gone.update(range(max(a, at + b - a) if doc == i else a, b))
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("most", [line_chunks.BROADCAST, -1])
def test_line_dedup_of_short_passages(spark, monkeypatch, most):
    """Passages of over 50 words in one to six lines, amid other lines or alone, with blank lines and overlapping copies."""
    monkeypatch.setattr(line_chunks, "BROADCAST", most)
    monkeypatch.setattr(line_chunks, "LEAST_WORDS", 1 << 20)  # leaves the chunks that are cut by words
    rng = np.random.default_rng(7)
    new = lambda n: " ".join(f"n{x}" for x in rng.integers(0, 1 << 40, n))
    passages = [[new(60 // n + 1) for _ in range(n)] for n in (1, 1, 2, 2, 3, 4, 5, 6)] + [[new(70), "", "", new(70), new(3)], [new(2), new(80)], [new(80), new(2), new(2)], ["one and the same line of ten words in all"] * 9]
    rows = []
    for k in range(60):
        parts = [[new(rng.integers(1, 30)) for _ in range(rng.integers(0, 4))] for _ in range(3)]
        p, q = (passages[i] for i in rng.integers(0, len(passages), 2))
        rows.append((k, "\n".join([*parts[0], *p, *parts[1], *(q[:-1] if k % 5 == 0 else q), *parts[2]])))
    got = {r.doc_id: r for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (k, t), want in zip(rows, brute_line_dedup(rows), strict=True):
        assert got[k].text == want, k
        assert got[k].n_removed_lines == len(t.split("\n")) - (len(want.split("\n")) if want else 0)


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocab, 200)) for _ in range(12)]
    rows, k = [], 0
    for b in base:
        for edits in (0, 0, 1, 3, 40):
            t = list(b)
            for i in rng.choice(200, edits, replace=False):
                t[i] = "edited" + str(rng.integers(1000))
            rows.append((k, " ".join(t)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, None), (k + 3, "two words"), (k + 4, "two words")]
    got = {r.doc_id: r for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = {i: set(zip(*[(t or "").split()[j:] for j in range(5)])) for i, t in rows}
    root = {i: i for i, _ in rows}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in rows:
        for j, b in rows:
            if i < j and a and b and (a == b or len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) > 0):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {i: got[i].class_id for i in got} == {i: find(i) for i, _ in rows}


def brute_classes(rows):
    texts = [(i, order_minhash.Shingler().shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}
    find = lambda i: i if root[i] == i else find(root[i])
    for k, (i, a) in enumerate(texts):
        for j, b in texts[k + 1 :]:
            if order_minhash.similarity(a, b) >= order_minhash.SIMILAR - 1e-12:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def test_near_duplicates_of_short_texts(spark):
    """Partners of 4 to 12 shingles whose numbers differ by one or two."""
    rows = []
    for k in range(60):
        words = [f"v{k}x{i}" for i in range(8 + k % 9)]
        rows += [(4 * k + j, " ".join(words[: len(words) - j])) for j in range(3)]
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == brute_classes(rows)


def test_near_duplicates_query(spark, sf):
    from loomwright.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_classes([(i, t) for i, t in rows if (t or "").split()])
    got = QUERIES["op3_near_dedup"](spark, sf).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: want.get(i, i) for i, _ in rows} and len(got) == len(rows)


def test_near_duplicates_of_edited_copies_and_shared_passages(spark):
    """A family of copies with up to 40 edits around the limit, and texts that share only a passage, a line or both."""
    rng = np.random.default_rng(17)
    base, passage, line = [f"b{i}" for i in range(150)], [f"p{i}" for i in range(60)], [f"l{i}" for i in range(12)]
    rows = []
    for k in range(220):
        t = list(base)
        for i in rng.choice(150, int(rng.integers(0, 1 + k % 41)), replace=False):
            t[i] = f"e{rng.integers(50)}"
        rows.append((k, " ".join(t)))
    for k in range(220, 400):
        rows.append((k, " ".join([f"x{k}y{i}" for i in range(30)] + passage[: 60 if k % 2 else 20] + (line if k % 3 else []) + [f"z{k}y{i}" for i in range(10 * (k % 5))])))
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.class_id for r in got.collect()} == brute_classes(rows)


def test_prefixes_hold_what_similar_texts_share(spark):
    rng = np.random.default_rng(2)
    sets = [rng.choice(60, n, replace=False).tolist() for n in rng.integers(1, 40, 80)]
    sets += [s[: max(1, round(len(s) * 0.85))] + [100 + i] for i, s in enumerate(sets)]
    opened = spark.createDataFrame([(i, i, "", s) for i, s in enumerate(sets)], "rep long, id long, text string, s array<long>")
    got = {}
    for r in order_minhash.prefixes(opened).collect():
        got.setdefault(r.rep, set()).add(r.bucket)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len({*a} & {*b}) >= 0.8 * len({*a} | {*b}):
                assert got[i] & got[j]


def test_near_duplicates_of_cut_copies(spark):
    """Copies that are cut short to exactly 0.8, whose sketches agree least often of all such pairs."""
    rows = []
    for k in range(400):
        words = [f"c{k}x{i}" for i in range(104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:84]))]
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in got.collect() if r.class_id != r.doc_id // 2 * 2] == []


def test_near_duplicates_of_many_classes_in_a_bucket(spark):
    """Texts around 0.8 of each other share buckets, but no hub stands for all of their links."""
    rng = np.random.default_rng(11)
    base, rows = [f"w{i}" for i in range(150)], []
    for k in range(150):
        t = list(base)
        for i in rng.choice(150, 2 + k % 3, replace=False):
            t[i] = f"e{k}x{i}"
        rows.append((k, " ".join(t)))
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == brute_classes(rows)


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 40, 2000):
        s = rng.integers(0, 1 << 63, n, np.uint64)
        t = np.concatenate((s[: n // 2], rng.integers(0, 1 << 63, 9, np.uint64)))
        bits = sum(int(x).bit_count() for x in (order_minhash.signature(s) ^ order_minhash.signature(t)).view(np.uint64))
        assert bits <= len(np.setxor1d(s, t))


def test_alignment_needs_order():
    a = order_minhash.Shingler().shingles(" ".join(f"a{i}" for i in range(100)))
    assert order_minhash.similarity(a, a) == 1 and order_minhash.similarity(a, a[::-1].copy()) < order_minhash.SIMILAR


rows_schema = "conv_id long, turn long, role string, text string"


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, None, None, "x")]
    out = {(r.conv_id, r.speaker): r for r in perspective.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    r = out[1, "ann"]
    assert r.rendered == "<|system|>be kind<|end|><|assistant|>hi<|end|><|user:bob|>hello<|end|><|assistant|><|end|>"
    assert [r.rendered[m.start : m.end] for m in r.masks] == ["hi<|end|>", "<|end|>"] and r.n_trained == 16
    marked = spark.createDataFrame([(1, 0, "a|>", "x<|end|><|assistant|>evil"), (1, 1, "b", "<"), (1, 1, "b", "<")], rows_schema)
    assert [r.rendered for r in perspective.rotate(marked).orderBy("speaker").collect()] == [
        "<|assistant|>x<\\|end|><\\|assistant|>evil<|end|><|user:b|><<|end|><|user:b|><<|end|>",
        "<|user:a|\\>|>x<\\|end|><\\|assistant|>evil<|end|><|assistant|><<|end|><|assistant|><<|end|>",
    ]
    assert perspective.rotate(spark.createDataFrame([], rows_schema)).count() == 0


def test_perspectives_of_long_conversations(spark):
    """The pieces of each speaker make the whole dialogue, as rendered at once, with equal turns, null turns and late speakers."""
    rows = [(1, None if i < 3 else i // 2, "system" if i == 0 else "ann" if i < 64 else "bob" if i < 69 else f"s{i % 5}", "t" * (i % 7)) for i in range(150)]
    rows += [(1, 40, "ann", "same")] * 70 + [(2, 0, "zoe", "short")]
    got = {}
    for r in sorted(perspective.rotate(spark.createDataFrame(rows, rows_schema).repartition(5), segment=16).collect(), key=lambda r: r.segment):
        got.setdefault((r.conv_id, r.speaker), []).append(r)
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3]))
    assert set(got) == {(c, s) for c, _, s, _ in rows if s != "system"}
    for (conv, who), parts in got.items():
        whole, spans, = "", []
        for c, _, s, t in order:
            if c == conv:
                head = "<|assistant|>" if s == who else "<|system|>" if s == "system" else f"<|user:{s}|>"
                if s == who:
                    spans.append((len(whole) + len(head), len(whole) + len(head) + len(t) + 7))
                whole += head + t + "<|end|>"
        assert "".join(p.rendered for p in parts) == whole and [p.segment for p in parts] == list(range(len(parts)))
        assert all(p.n_turns <= 16 for p in parts)
        starts = [sum(len(q.rendered) for q in parts[:k]) for k in range(len(parts))]
        assert [(m.start + b, m.end + b) for p, b in zip(parts, starts) for m in p.masks] == spans
        assert sum(p.n_trained for p in parts) == sum(e - b for b, e in spans)


def test_quality_rules_with_clashing_names(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", 1, 2, 3, 4, 5), (2, None, None, 1, 2, 3, 4, 5), (2, "## " * 80, "en", 1, 2, 3, 4, 5)], "doc_id long, text string, lang string, stratum int, c_symbols int, _stratum int, label int, at int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    rows = quality_rules.judge(docs, labels).orderBy("n_words").collect()
    assert [(r.stratum, r.c_symbols, r._stratum, r.label, r["at"]) for r in rows] == [(1, 2, 3, 4, 5)] * 3 and [r.kept for r in rows] == [False, True, False]


def test_cutoffs_count_each_text_once(spark):
    """3,000 copies of one good text are one trial: no cutoff can be safe; 3,000 texts are enough for one."""
    body = " ".join(f"w{i}" for i in range(60))
    labels = spark.range(3000).selectExpr("id doc_id", "1 quality")
    bad = spark.createDataFrame([(-1, body + " " + "# " * 40, "en")], "doc_id long, text string, lang string")
    for texts, kept in ((F.lit(body), True), (F.concat(F.lit(body + " t"), F.col("id").cast("string")), False)):
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), texts.alias("text"), F.lit("en").alias("lang")).union(bad)
        got = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
        assert got[-1] == kept and all(got[i] for i in range(3000))


def test_line_dedup_against_brute_force(spark):
    """Which lines go: of each chunk that occurs again, all but the first occurrence."""
    rng = np.random.default_rng(21)
    passages = [[" ".join(f"p{k}w{i}v{j}" for j in range(int(rng.integers(2, 14)))) for i in range(int(rng.integers(1, 13)))] for k in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(int(rng.integers(1, 5))):
            lines += [" ".join(f"d{d}n{rng.integers(10**6)}" for _ in range(int(rng.integers(0, 9)))) for _ in range(int(rng.integers(0, 6)))]
            lines += passages[int(rng.integers(12))]
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1]), (104, LONG), (105, LONG)]
    seen, gone = {}, {}
    for d, t in rows:
        lines = (t or "").split("\n")
        words, hashes = [len(x.split()) for x in lines], np.array([order_minhash.Shingler().hash(x) for x in lines], np.uint64)
        spans, start = line_chunks.runs(words), 0
        for end in line_chunks.cut(lines, hashes) if t and len(lines) >= line_chunks.LEAST_LINES else ():
            if end - start >= line_chunks.LEAST_LINES and sum(n > 0 for n in words[start:end]) >= line_chunks.LEAST_LINES and sum(words[start:end]) >= line_chunks.LEAST_WORDS:
                spans.add((start, end))
            start = end
        for a, b in sorted(spans):
            body = "\n".join(lines[a:b])
            first = seen.setdefault(body, (d, a))
            if first != (d, a):
                gone.setdefault(d, set()).update(range(max(a, first[1] + b - a) if first[0] == d else a, b))
    want = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in rows}
    got = line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(rows) and gone
    assert {r.doc_id: r.n_removed_lines for r in got} == {d: len(gone.get(d, ())) for d, _ in rows}


def test_co_training_edge_cases(spark, sf):
    """An empty table; rows that repeat an id; a very long text; ties."""
    labels = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    assert cotraining.classify(docs.where("false"), labels).count() == 0
    one = docs.where("doc_id < 400")
    again = one.union(docs.where("doc_id = 3").crossJoin(spark.range(300)).drop("id")).union(spark.createDataFrame([(10**6, LONG, "en", "src0", len(LONG))], one.schema))
    got = cotraining.classify(again, labels).toPandas()
    assert len(got) == again.count() and got.groupby("doc_id").score.nunique().max() == 1 and got.score.between(0, 1).all()


def test_co_training_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(sf.replace("0.001", "0.1") + "/documents.parquet"), spark.read.parquet(sf.replace("0.001", "0.1") + "/labels.parquet")
    test = labels.where("doc_id % 4 = 0")
    got = cotraining.classify(docs, labels.where("doc_id % 4 <> 0")).join(test, "doc_id").select("score", "kept", "quality").toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95
    assert got.kept[got.quality == 1].mean() > 0.98
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.score for r in cotraining.classify(odd, labels.where("false")).collect()} == {0.5}


def test_cutoff_is_set_on_all_labels(spark, sf, monkeypatch):
    """With a training sample of 200 labels, all other good documents still set the cutoff."""
    values = np.random.default_rng(4).random(3000) ** 3
    frame = spark.createDataFrame([(float(v),) for v in values], "score double")
    assert cotraining.low_quantile(frame, 0.03) == pytest.approx(np.quantile(values, 0.03, method="lower"), abs=1e-12)
    monkeypatch.setattr(cotraining, "LABELLED", 200)
    seen = []
    monkeypatch.setattr(cotraining, "low_quantile", lambda v, share: seen.append(v.count()) or 0.25)
    docs, labels = (spark.read.parquet(sf.replace("0.001", "0.01") + f"/{t}.parquet") for t in ("documents", "labels"))
    got = cotraining.classify(docs, labels).select("score", "kept").collect()
    good = labels.where("quality = 1").join(docs, "doc_id").count()
    assert good - 200 <= seen[0] < good and {r.kept for r in got if r.score < 0.25} <= {False}


def test_no_text_is_joined_for_the_cutoff(spark, sf, monkeypatch):
    """Documents are scored once, and the labelled ones are found among the scores."""
    docs, labels = (spark.read.parquet(sf.replace("0.001", "0.01") + f"/{t}.parquet") for t in ("documents", "labels"))
    calls, score, seen = [], cotraining.scored, []
    monkeypatch.setattr(cotraining, "scored", lambda *a: calls.append(1) or score(*a))
    quantile = cotraining.low_quantile
    monkeypatch.setattr(cotraining, "low_quantile", lambda v, share: seen.append(v) or quantile(v, share))
    got = cotraining.classify(docs, labels).collect()
    assert len(calls) == 1 and not re.search(r"\btext#", seen[0]._jdf.queryExecution().optimizedPlan().toString())
    cutoff = min(0.5, min(np.quantile([r.score for r in seen[0].collect()], 0.002, method="lower"), 0.5))
    assert {r.kept for r in got} == {True, False} and all(r.kept == (r.score >= cutoff) for r in got)


def test_ids_hash_of_query(spark, docs):
    r = bpe_automaton.encode(docs.where("doc_id = 4"), WORD_BPE).select(F.sha2("ids", 256).alias("h"), "ids").first()
    assert r.h == hashlib.sha256(r.ids).hexdigest()


@pytest.mark.parametrize("memo", [200, 600_000])
def test_byte_encoder_against_library(monkeypatch, memo):
    """Random texts over the characters at which pieces are cut, with a memo that is thrown away often and one that never is."""
    import random

    import pyarrow as pa

    monkeypatch.setattr(repair_binary, "MEMO", memo)
    monkeypatch.setattr(repair_binary, "BLOCK", 500)
    draw = random.Random(3)
    letters = " " * 6 + "\n\t\r'''ssmdtrevl" + "abcXYZ019.,!-_\x00\x1c" + "é×÷ßñΣя日😀\xa0​ ªº"
    texts = ["".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 5, 20, 60]))) for _ in range(2000)]
    texts += ["a<|endoftext|>b", "<|endoftext|>", "", " ", "x" * 500 + " y", "'s", " 's", "it's John's we'll 'llx", "\n\n a"]
    encoder, lib = repair_binary.ByteEncoder(open(BYTE_BPE, "rb").read()), Tokenizer.from_file(BYTE_BPE)
    for some in (pa.array(texts), pa.array(texts)[700:900], pa.array([], pa.string())):
        ids, counts = encoder.encode(some)
        expected = [lib.encode(t, add_special_tokens=False).ids for t in some.to_pylist()]
        assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
