"""Operator 5: token counts by finite-state tokenizer compilation.

The merge automaton is turned into a subsequential transducer over characters. A transducer state is the set of pending
starts that a later character can still complete: for each of them the characters read since (a proper prefix of some
token), the automaton state there, and its token count relative to now. A transition is annotated with the number of tokens
by which the count changes, so a word's count is the sum of the annotations on its path. States and transitions are compiled
when first visited; there are finitely many, as tokens have a greatest length.

Longer texts than CHUNK characters are cut into chunks, which are rows of their own: the chunks of one text are mapped in
many tasks. A chunk's state map is symbolic: what precedes its first white space (its head) and follows its last (its tail)
depend on neighbours, all between doesn't, for white space takes every state to the start state. Maps compose
associatively, and a text's maps are folded pairwise in a balanced tree, as in a prefix scan; only heads and tails, the pieces
of words that chunks cut, come together for it. A text without any white space is one piece, and is put together whole.

Results by case: a null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; an empty table
gives an empty result; other columns stay, clashing ones are replaced. No text is truncated.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.base import fresh, stored
from loomwright.llm.bpe_automaton import MEMO, SPACES, STATES, MergeAutomaton, WordCodec, codec, map_texts, vocabulary

CHUNK = 1 << 16


class CountingTransducer:
    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        self.prefixes = automaton.prefixes
        self._reset()

    def _reset(self) -> None:
        start = (("", 0, 0),)
        self.keys: list[tuple] = [start]
        self.index = {start: 0}
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]
        self.ends: list[dict[str, int]] = [{}]

    def _gain(self, pending: tuple, c: str, end: str) -> tuple[int, int]:
        """The automaton state after c and the annotation: exactly one pending start completes a token that is allowed."""
        a = self.automaton
        for seen, state, ahead in pending:
            t = a.vocab.get(seen + c + end)
            if t is not None and a.allows(state, t):
                return a.target[t], ahead + 1
        raise ValueError("no transition")

    def arc(self, s: int, c: str) -> tuple[int, int]:
        pending = self.keys[s]
        state, gain = self._gain(pending, c, "")
        key = (*((seen + c, q, ahead - gain) for seen, q, ahead in pending if seen + c in self.prefixes), ("", state, 0))
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.keys)
            self.keys.append(key)
            self.arcs.append({})
            self.ends.append({})
        self.arcs[s][c] = to, gain
        return to, gain

    def count(self, piece: str) -> int:
        """Tokens of one piece in the byte alphabet: the annotations along its path."""
        if len(self.keys) > STATES:
            self._reset()  # bounds memory; the transducer is compiled anew as far as it is visited
        s, n, arcs = 0, 0, self.arcs
        for c in piece[:-1]:
            s, gain = arcs[s].get(c) or self.arc(s, c)
            n += gain
        last = piece[-1]
        gain = self.ends[s].get(last)
        if gain is None:
            gain = self.ends[s][last] = self._gain(self.keys[s], last, self.automaton.suffix)[1]
        return n + gain


class TextCounter:
    """Counts of words, with a bounded memo, and state maps of chunks."""

    def __init__(self, codec: WordCodec):
        self.codec = codec
        self.fst = CountingTransducer(codec.automaton)
        self._words: dict[str, int] = {}
        self.first = re.compile(f"[{SPACES}]").search

    def release(self) -> None:
        """Give the tables back when a task ends; the memo of words, which is bounded, serves the worker's next task."""
        self.fst._reset()
        self.codec.release()

    def word(self, word: str) -> int:
        n = self._words.get(word)
        if n is None:
            count = self.fst.count
            n = sum([count(p) for p in self.codec.split(word)])
            if len(word) <= 64:
                if len(self._words) >= MEMO:
                    self._words.clear()
                self._words[word] = n
        return n

    def closed(self, text: str) -> int:
        """Tokens of a stretch that begins and ends at white space or at a text's ends."""
        if "<|" in text or self.codec.odd(text):
            return sum([1 if special is not None else self.word(w) for w, special in self.codec.words(text)])
        known = self._words
        return sum([n if (n := known.get(w)) is not None else self.word(w) for w in text.split()])

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, tokens between, tail); without white space (chunk, None, '')."""
        at = self.first(chunk)
        if at is None:
            return chunk, None, ""
        last = len(chunk) - 1
        while not self.first(chunk, last, last + 1):
            last -= 1
        return chunk[: at.start()], self.closed(chunk[at.start() : last]) if last > at.start() else 0, chunk[last + 1 :]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None and b[1] is None:
            return a[0] + b[0], None, ""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.closed(a[2] + b[0]) + b[1], b[2]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.closed(text)
        return self.folded([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])

    def folded(self, maps: list[tuple]) -> int:
        """The count of a text from its chunks' maps."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, between, tail = maps[0]
        return self.closed(head) + (between or 0) + self.closed(tail)


@lru_cache(2)
def counter(raw: bytes) -> TextCounter:
    return TextCounter(codec(raw))


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """df with ``n_bytes`` long (UTF-8), ``n_tokens`` long and ``over_limit`` boolean."""
    raw = vocabulary(df, tokenizer)
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    body = F.col(f"`{text}`").cast("string")
    long_ = F.coalesce(F.length(body) > chunk, F.lit(False))

    def make():
        c = counter(raw.value)

        def one(t):
            n = c.count(t or "", chunk)
            return len((t or "").encode()), n, n > limit

        return one, c.release

    short = map_texts(df.where(~long_), text, fields, make)

    def cut(batches):
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                t = t.as_py()
                for k in range(0, len(t), chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()]), pa.array([k // chunk], pa.int32()), pa.array([t[k : k + chunk]])], names=["i", "k", "t"])

    def mapped(batches):
        c = counter(raw.value)
        for b in batches:
            maps = [c.chunk_map(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([m[j] for m in maps], t) for j, t in enumerate((pa.string(), pa.int64(), pa.string())))], names=["i", "k", "head", "between", "tail"])
        c.release()

    def folded(batches):
        c = counter(raw.value)
        for b in batches:
            n = [c.folded([(m["head"], m["between"], m["tail"]) for m in maps.as_py()]) for maps in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["i", "n"])
        c.release()

    row, i, n = fresh(short, "row", "i", "n")
    longer = stored(df.where(long_).withColumn(row, F.monotonically_increasing_id()), "long")
    maps = longer.select(row, body).mapInArrow(cut, "i long, k int, t string").repartition("i", "k").mapInArrow(mapped, "i long, k int, head string, between long, tail string")
    counts = maps.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("k", "head", "between", "tail"))).alias("maps")).mapInArrow(folded, "i long, n long").withColumnsRenamed({"i": i, "n": n})
    longer = longer.join(counts, F.col(row) == F.col(i))
    kept = [F.col(f"`{c}`") for c in short.columns[: -len(fields)]]
    return short.union(longer.select(*kept, F.octet_length(body).cast("long"), F.col(n), F.col(n) > limit))
