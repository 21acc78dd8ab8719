"""Operator 8: token-id output in a grammar-compressed binary format (Re-Pair).

Documents are range-partitioned and sorted by key. Each partition is cut into shards of about SHARD_IDS ids. In a shard,
Re-Pair repeats until no pair of adjacent symbols occurs LEAST times. A pass gives nonterminals to all pairs that do and
replaces their occurrences; where two overlap, the more frequent pair goes first, and the other is counted again in the
next pass. No pair spans two documents. A shard is one row of the output files:

``part, shard, offset`` (ids of the partition before it), ``keys`` (document keys, ascending), ``ends`` (end of each
document in symbols, u32), ``rules`` (pairs of symbols, u32; rule k is symbol base + k), ``lengths`` (ids that each rule
expands to, u32), ``symbols`` (u16 if all fit, else u32), ``base`` and ``n_ids``.

A document is decoded alone from its symbols and the rules; ``lengths`` gives the place of any id without expansion, so that
a range of ids is decoded from the symbols that cover it.
The files are Parquet, written by Spark's committer, so that lost executors are written again and any store will do.

Results by case: a null text is the empty text, so the document is its end id alone; rows with equal keys follow each
other, in text order unless they are so many that they fill several partitions; null keys come first; an empty table gives files without rows; other columns aren't written.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_IDS = 1 << 20
#: A pair that occurs this often in its shard gets a rule (of 12 bytes).
LEAST = 16
#: Bits of the table that finds a pair's rule; of pairs that share a place, the most frequent goes first.
PLACES = 20
#: Pieces whose ids a worker remembers, about 60 bytes each.
MEMO = 600_000

SHARDS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("base", T.LongType()),
    T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("ends", T.BinaryType()), T.StructField("rules", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("symbols", T.BinaryType()),
])


def repair(ids: np.ndarray, last: np.ndarray, base: int, least: int = LEAST):
    """(symbols, last, rules as an array of pairs). ``last`` marks the final id of each document; no rule spans it.

    Symbols are a linked list. After a pass, only pairs that hold a new symbol, or that gave way to another pair, can occur
    ``least`` times, so a pass looks at these alone.
    """
    n, made, rules = len(ids), 0, [np.empty((0, 2), np.uint32)]
    sym, last, gone = ids.astype(np.uint32), last.copy(), np.zeros(n, bool)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    pos = np.flatnonzero(~last).astype(np.int32)
    while len(pos):
        narrow = base + made <= 1 << 16  # two symbols fit 32 bits, which sort faster
        wide, shift, odd = (np.uint32, 16, 0x9E3779B1) if narrow else (np.uint64, 32, 0x9E3779B97F4A7C15)
        codes = (sym[pos].astype(wide) << wide(shift)) | sym[after[pos]]
        order = np.sort(codes)
        starts = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        counts = np.diff(np.append(starts, len(order)))
        often = counts >= least
        chosen, counts = order[starts[often]], counts[often]
        if not len(chosen):
            break
        by_count = np.lexsort((chosen, -counts))
        rank = np.empty(len(chosen), np.int32)
        rank[by_count] = np.arange(len(chosen), dtype=np.int32)
        place = lambda c, odd=wide(odd), rest=wide(2 * shift - PLACES): (c * odd) >> rest
        table, shared = np.zeros(1 << PLACES, np.int32), np.zeros(1 << PLACES, bool)
        slots = place(chosen)
        table[slots[by_count[::-1]]] = by_count[::-1]  # the most frequent is written last
        shared[slots[table[slots] != np.arange(len(chosen))]] = True
        slot = place(codes)
        at = table[slot]
        hit = chosen[at] == codes
        waiting = pos[shared[slot] & ~hit]
        pos, at = pos[hit], at[hit]
        # an occurrence gives way to a neighbour of better rank; of a run of one pair, every other one is taken
        r, meets = rank[at], after[pos[:-1]] == pos[1:]
        lost = np.zeros(len(pos), bool)
        lost[:-1] |= meets & (r[1:] < r[:-1])
        lost[1:] |= meets & (r[:-1] < r[1:])
        kept = np.flatnonzero(~lost)
        run = np.concatenate(([True], after[pos[kept[:-1]]] != pos[kept[1:]]))
        first = np.maximum.accumulate(np.where(run, np.arange(len(kept)), 0))
        kept = kept[(np.arange(len(kept)) - first) % 2 == 0]
        good = np.bincount(at[kept], minlength=len(chosen)) >= max(1, least // 2)  # holds for the first of all
        kept = kept[good[at[kept]]]
        where = pos[kept]
        sym[where] = base + made + (np.cumsum(good) - 1)[at[kept]]
        second = after[where]
        gone[second], last[where] = True, last[second]
        after[where] = after[second]
        some = after[where] < n
        before[after[where][some]] = where[some]
        rules.append(np.stack((chosen[good] >> wide(shift), chosen[good] & wide((1 << shift) - 1)), 1).astype(np.uint32))
        made += int(good.sum())
        marked = np.zeros(n + 1, bool)  # a place before the first one is -1, the last of these
        for some in (pos, waiting, where, before[where]):
            marked[some] = True
        pos = np.flatnonzero(marked[:n]).astype(np.int32)
        pos = pos[~(gone[pos] | last[pos])]
    return sym[~gone], last[~gone], np.concatenate(rules)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to; a rule only uses rules before it."""
    out = np.ones(len(rules), np.uint32)
    done = 0
    while done < len(rules):  # all rules that use finished ones only, at once: one pass for each round
        ready = (rules[done:] < base + done).all(1)
        end = done + (len(ready) if ready.all() else max(1, int(np.argmin(ready))))
        r = rules[done:end].astype(np.int64) - base
        out[done:end] = np.where(r >= 0, out[np.maximum(r, 0)], 1).sum(1)
        done = end
    return out


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all rules' expansions in a row, where each starts, how many each has); a rule only uses rules before it."""
    count = rule_lengths(rules, base).astype(np.int64)
    start = np.cumsum(count) - count
    pool = np.empty(int(count.sum()), np.uint32)
    places = list(zip(start.tolist(), count.tolist(), strict=True))
    for (at, n), (a, b) in zip(places, (rules.astype(np.int64) - base).tolist(), strict=True):
        if a < 0:
            pool[at] = a + base
            at += 1
        else:
            x, m = places[a]
            pool[at : at + m] = pool[x : x + m]
            at += m
        if b < 0:
            pool[at] = b + base
        else:
            x, m = places[b]
            pool[at : at + m] = pool[x : x + m]
    return pool, start, count


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, known: tuple | None = None) -> np.ndarray:
    """The ids that symbols stand for. known: the rules' expansions, if they are at hand."""
    rule = symbols.astype(np.int64) - base
    if not len(rule) or rule.max() < 0:
        return symbols.astype(np.uint32)
    pool, start, count = expansions(rules, base) if known is None else known
    big = rule >= 0
    rule = np.maximum(rule, 0)
    size = np.where(big, count[rule], 1)
    # plain ids lie behind the pool
    source = np.where(big, start[rule], len(pool) + np.arange(len(rule)))
    both = np.concatenate((pool, symbols.astype(np.uint32)))
    return both[np.repeat(source - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


#: Classes of bytes: blank, other white space, letter, digit, other ASCII, apostrophe, byte of a character beyond ASCII.
BLANK, SPACE, LETTER, DIGIT, OTHER, QUOTE, BEYOND = range(7)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for b in range(256):
        c = chr(b)
        out[b] = BEYOND if b > 127 else BLANK if c == " " else SPACE if c in "\t\n\v\f\r" else QUOTE if c == "'" else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER
    return out


def _borders() -> np.ndarray:
    """Whether a piece starts between two bytes, by class before * 8 + class after; the last white space of a run comes on top.

    The vocabulary's pre-split never joins ASCII letters, digits and other characters, but for an apostrophe and letters
    after it; one blank belongs to what follows. Characters beyond ASCII stay with their neighbours.
    """
    out = np.zeros(64, bool)
    for x in range(7):
        for y in range(7):
            if y in (BLANK, SPACE):
                out[x * 8 + y] = x not in (BLANK, SPACE)
            elif x in (BLANK, SPACE):
                out[x * 8 + y] = x == SPACE
            elif BEYOND not in (x, y):
                kind = [OTHER if z == QUOTE else z for z in (x, y)]
                out[x * 8 + y] = kind[0] != kind[1] and not (x == QUOTE and y == LETTER)
    return out


CLASSES, BORDERS = _classes(), _borders()
#: White space beyond ASCII; a text that holds some is encoded as a whole.
WIDE_SPACES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
WIDE_SPACE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
#: The longest piece, in bytes, whose ids are found by table; bits of the table, places that a key may take, pieces looked up at once.
SHORT, BITS, PROBES, BLOCK = 23, 22, 4, 1 << 19
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class ByteEncoder:
    """The tokenizers library, called once for each distinct piece of text; pieces are cut and looked up as arrays.

    A piece of up to SHORT bytes is its own key (three words of 8 bytes, the last with its length), so a lookup in the
    hash table compares whole pieces. Longer pieces, and the few for which the table has no free place, are kept in a
    dict. All is forgotten when MEMO pieces are known. Ids of a text are the ids of its pieces in a row.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.size = self.tokenizer.get_vocab_size()
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.needles = [*added, *WIDE_SPACES]
        self.odd = re.compile(b"|".join([*map(re.escape, added), WIDE_SPACE]))
        self.clear()

    def clear(self) -> None:
        self.table = np.zeros(1 << BITS, np.int32)
        self.words = np.zeros((1, 3), np.uint64)  # entry 0 is no piece: its length is 0
        self.at, self.count, self.pool = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.rest: dict[bytes, int] = {}

    @staticmethod
    def _hash(words: np.ndarray) -> np.ndarray:
        h = words[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29)) ^ words[:, 1]) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(31)) ^ words[:, 2]) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - BITS)).astype(np.int64)

    def _find(self, words: np.ndarray) -> np.ndarray:
        """Entry of each key, 0 if unknown."""
        h = self._hash(words)
        found = self.table[h]
        found[(self.words[found] != words).any(1)] = 0
        for p in range(1, PROBES):
            left = np.flatnonzero(found == 0)
            if not len(left):
                break
            e = self.table[(h[left] + p) & ((1 << BITS) - 1)]
            found[left] = np.where((self.words[e] == words[left]).all(1), e, 0)
        return found

    def _learn(self, pieces: list[bytes], words: np.ndarray, short: np.ndarray) -> np.ndarray:
        """New entries for distinct pieces."""
        new = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]
        count = np.array([len(x) for x in new], np.int64)
        entry = len(self.count) + np.arange(len(new))
        self.at = np.concatenate((self.at, len(self.pool) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.pool = np.concatenate((self.pool, np.array([i for x in new for i in x], np.uint32)))
        self.words = np.concatenate((self.words, np.where(short[:, None], words, 0)))
        left = np.flatnonzero(short)
        h = self._hash(words)
        for p in range(PROBES):
            place = (h[left] + p) & ((1 << BITS) - 1)
            free = self.table[place] == 0
            place, first = np.unique(place[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.table[place] = entry[left[took]]
            left = np.delete(left, took)
        for k in (*np.flatnonzero(~short).tolist(), *left.tolist()):
            self.rest[pieces[k]] = int(entry[k])
        return entry

    def _pieces(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces start."""
        kind = CLASSES[buf]
        lead = np.flatnonzero(buf[:-1] == 0xC3)  # Latin letters of two bytes
        tail = buf[lead + 1]
        lead = lead[(tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        start = np.ones(len(buf), bool)
        start[1:] = BORDERS[(kind[:-1] << 3) | kind[1:]]
        space = kind <= SPACE
        lone = space[:-1].copy()  # the last white space of a run, if more of the text follows
        lone[1:] &= space[:-2]
        lone &= ~space[1:]
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(buf))]
        lone[inner - 1] = False
        start[:-1] |= lone
        start[inner] = True
        return np.flatnonzero(start)

    def _plain(self, blob: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) for texts that lie one after the other between the bounds."""
        if not blob:
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        padded = np.frombuffer(blob + bytes(32), np.uint8)
        starts = self._pieces(padded[: len(blob)], bounds)
        size = np.diff(np.append(starts, len(blob)))
        eight = np.ndarray((len(blob) + 24,), "<u8", padded, strides=(1,))
        ids, counts = [], []
        for k in range(0, len(starts), BLOCK):
            if len(self.count) > MEMO:
                self.clear()
            s, n = starts[k : k + BLOCK], size[k : k + BLOCK]
            words = np.stack([eight[np.minimum(s + 8 * j, len(blob))] & LOW_BYTES[np.clip(n - 8 * j, 0, 8)] for j in range(3)], 1)
            short = n <= SHORT
            words[:, 2] |= np.where(short, n, 0).astype(np.uint64) << np.uint64(56)
            found = np.where(short, self._find(words), 0)
            miss = np.flatnonzero(found == 0)
            if len(miss):
                pieces = [blob[x : x + m] for x, m in zip(s[miss].tolist(), n[miss].tolist(), strict=True)]
                first = {p: i for i, p in enumerate(pieces) if p not in self.rest}
                at = miss[list(first.values())]
                entries = self._learn(list(first), words[at], short[at]) if first else []
                new = dict(zip(first, np.asarray(entries).tolist(), strict=True))
                found[miss] = [new[p] if p in new else self.rest[p] for p in pieces]
                for p in new:
                    if len(p) > 256:
                        self.rest.pop(p, None)
            c = self.count[found]
            base = np.repeat(self.at[found] - (np.cumsum(c) - c), c)
            ids.append(self.pool[base + np.arange(len(base))])
            counts.append(c)
        upto = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        return np.concatenate(ids), np.diff(upto[np.searchsorted(starts, bounds)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        blob = bytes(memoryview(texts.buffers()[2])[bounds[0] : bounds[-1]]) if bounds[-1] > bounds[0] else b""
        bounds -= bounds[0]
        if not any(x in blob for x in self.needles):
            return self._plain(blob, bounds)
        whole = {i for m in self.odd.finditer(blob) for i in range(*np.searchsorted(bounds, [m.start(), m.end() - 1], "right") - [1, 0])}
        ids, counts, done = [], [], 0
        for i in [*sorted(whole), len(texts)]:
            if i > done:
                some, n = self._plain(blob[bounds[done] : bounds[i]], bounds[done : i + 1] - bounds[done])
                ids.append(some)
                counts.append(n)
            if i < len(texts):
                e = self.tokenizer.encode_batch_fast([blob[bounds[i] : bounds[i + 1]].decode("utf-8", "replace")], add_special_tokens=False)[0].ids
                ids.append(np.array(e, np.uint32))
                counts.append(np.array([len(e)]))
            done = i + 1
        return np.concatenate(ids), np.concatenate(counts)


@lru_cache(2)
def byte_encoder(raw: bytes) -> ByteEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return ByteEncoder(raw)


def shard_row(part: int, shard: int, offset: int, keys: list, ids: np.ndarray, ends: np.ndarray, base: int) -> dict:
    """ends: behind the last id of each document."""
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    symbols, last, rules = repair(ids, last, base)
    ends = (np.flatnonzero(last) + 1).astype(np.uint32)
    small = not len(symbols) or symbols.max() < 1 << 16
    return {"part": part, "shard": shard, "offset": offset, "n_ids": len(ids), "base": base, "keys": keys, "ends": ends.tobytes(), "rules": rules.tobytes(), "lengths": rule_lengths(rules, base).tobytes(), "symbols": symbols.astype("<u2" if small else "<u4").tobytes() + bytes([2 if small else 4])}


def slices(batch: pa.RecordBatch, most: int = 4 << 20):
    """Slices of a batch of (key, text) with about so many bytes of text, one row at least."""
    sizes, at = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 4096]), most, "right")))
        yield batch.slice(at, n)
        at += n


def write_ids(df: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encode all texts, append end_id to each, and write the shards to path, keys ascending (null first)."""
    from loomwright.llm.bpe_automaton import vocabulary

    raw = vocabulary(df, tokenizer)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # the row's number spreads rows with one key, which may be a third of all
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(F.col("key").asc_nulls_first(), "tie").select("key", "text").sortWithinPartitions(F.col("key").asc_nulls_first(), "text")

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        encoder, part, arrow = byte_encoder(raw.value), TaskContext.get().partitionId(), to_arrow_schema(SHARDS)
        base, keys, held, ends, size, shard, offset = max(encoder.size, end_id + 1), [], [], [], 0, 0, 0

        def row():
            return pa.RecordBatch.from_pylist([shard_row(part, shard, offset, keys, np.concatenate(held), np.concatenate(ends), base)], schema=arrow)

        for batch in batches:
            for some in slices(batch):
                ids, counts = encoder.encode(some.column(1))
                stops = np.cumsum(counts + 1)
                full = np.full(int(stops[-1]), end_id, np.uint32)
                own = np.ones(len(full), bool)
                own[stops - 1] = False
                full[own] = ids
                done, names = 0, some.column(0).to_pylist()
                while done < len(names):  # a shard ends with the document that fills it
                    before = int(stops[done - 1]) if done else 0
                    upto = min(int(np.searchsorted(stops, before + shard_ids - size)) + 1, len(names))
                    keys += names[done:upto]
                    held.append(full[before : int(stops[upto - 1])])
                    ends.append(stops[done:upto] - before + size)
                    size += len(held[-1])
                    done = upto
                    if size >= shard_ids:
                        yield row()
                        keys, held, ends, size, shard, offset = [], [], [], 0, shard + 1, offset + size
        if keys:
            yield row()

    rows.mapInArrow(run, SHARDS).write.parquet(path)


def decode_shard(row: dict) -> list[np.ndarray]:
    """The ids of each document of a shard."""
    width = row["symbols"][-1]
    symbols = np.frombuffer(row["symbols"][:-1], f"<u{width}")
    rules, lengths, base = np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4"), row["base"]
    ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
    wide = symbols.astype(np.int64) - base
    size = np.where(wide >= 0, lengths[np.maximum(wide, 0)] if len(lengths) else 1, 1)
    return np.split(expand(symbols, rules, base), np.cumsum(size)[ends - 1][:-1]) if len(ends) else []


def read_document(row: dict, k: int) -> np.ndarray:
    """Random access: the ids of the k-th document of a shard, from its symbols alone."""
    ends = np.frombuffer(row["ends"], "<u4")
    symbols = np.frombuffer(row["symbols"][:-1], f"<u{row['symbols'][-1]}")[int(ends[k - 1]) if k else 0 : int(ends[k])]
    return expand(symbols, np.frombuffer(row["rules"], "<u4").reshape(-1, 2), row["base"])


def read_ids_at(row: dict, start: int, count: int) -> np.ndarray:
    """Random access: ``count`` ids of a shard from its id ``start`` on; only the symbols that cover them are expanded."""
    width, base = row["symbols"][-1], row["base"]
    symbols = np.frombuffer(row["symbols"][:-1], f"<u{width}")
    lengths, wide = np.frombuffer(row["lengths"], "<u4"), symbols.astype(np.int64) - base
    upto = np.cumsum(np.where(wide >= 0, lengths[np.maximum(wide, 0)] if len(lengths) else 1, 1))
    stop = min(start + count, row["n_ids"])
    if stop <= start:
        return np.zeros(0, np.uint32)
    lo, hi = int(np.searchsorted(upto, start, "right")), int(np.searchsorted(upto, stop - 1, "right")) + 1
    skip = start - (int(upto[lo - 1]) if lo else 0)
    return expand(symbols[lo:hi], np.frombuffer(row["rules"], "<u4").reshape(-1, 2), base)[skip : skip + stop - start]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``key``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` binary, ``crc32``."""
    shards = spark.read.schema(SHARDS).parquet(path)
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("inner", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("crc32", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs = [d.astype("<u4").tobytes() for d in decode_shard(row)]
                n = np.array([len(d) // 4 for d in docs], np.int64)
                cols = [np.full(len(docs), row["part"], np.int32), pa.array(row["keys"], pa.int64()), row["offset"] + np.cumsum(n) - n, n, docs, np.array([zlib.crc32(d) for d in docs], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    from pyspark.sql import Window

    # one row for each written partition: their number is set by the session, not by the data
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min(F.when(F.col("shard") == 0, F.coalesce(F.element_at("keys", 1), F.lit(-(1 << 63))))).alias("lo"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("lo", "part")) - F.col("n")).alias("before"))
    found = shards.mapInArrow(run, out).join(F.broadcast(parts), "part")
    return found.select("key", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids", "crc32")
