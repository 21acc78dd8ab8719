"""Operator 9: BPE encoding and decoding by a tokenization automaton.

The merges of a word-end BPE vocabulary are compiled into a deterministic automaton over token ids whose language is
exactly the set of correct tokenizations. It starts as one state with a loop for every base symbol. Each merge (u, v) -> w,
in rank order, inserts one gadget: u now leads to a copy of its old target that has lost the arc v, and every state with
an arc u gains an arc w to where v led. An arc set is never copied: the states that u leads to, one after the other, lose one
arc each, the first of them being a copy of where u led when it was made; so what a state lost is looked up by (u, v), along
these firsts. An arc w exists in a state exactly if its left part u did when w was made: that is looked up along the left spine.

A pre-split word is encoded from left to right, along the longest arc that leads on. Every prefix has exactly one accepted
path, so the state at a place is the same whenever the walk comes there, and a place that leads nowhere is not tried again.
A word that is a token is the one arc from the start. The ids are the arcs of the path; decoding emits their labels.

Results by case: a null text is the empty text (no tokens, decoded text ''); empty texts likewise; repeated rows give
repeated results; an empty table gives an empty result; other columns are kept, and operator columns that clash with
them are replaced. Very long texts are streamed word by word; output batches are cut by bytes.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed values of the vocabulary file's format: its white space and its pre-split pattern.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACES + r"\p{L}\p{N}]+"

#: Words kept per worker, and as many of those known before; this bounds memory and no result depends on it.
MEMO = 150_000
#: States of the counting transducer's table kept per worker, likewise.
STATES = 150_000
OUT_BYTES = 4 << 20


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where printable, else the next unused character from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class MergeAutomaton:
    """The automaton. State 0 is the start; ``target[t]`` is the state that token t leads to from any state that allows it."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        size = max(vocab.values(), default=-1) + 1
        self.labels: list[str] = [""] * size
        for token, i in vocab.items():
            self.labels[i] = token
        self.left: list[int] = [-1] * size
        self.born: list[int] = [-1] * size
        self.target = [0] * size
        self.live = [True] * size
        self.owner, self.when = [-1], [-1]  # of each state: the token whose gadget made it, and when
        self.origin = [0] * size  # the state that a token led to when it was made
        self.gadgets: dict[int, int] = {}  # the state that lost arc v after u, by u * size + v
        self._known: dict[int, bool] = {}
        self._size = size
        made = {vocab[a + b] for a, b in pairs}
        for w in made:
            self.live[w] = False  # until its merge is reached
        for time, (a, b) in enumerate(pairs):
            self._gadget(vocab[a], vocab[b], vocab[a + b], time)
        plain = [t.removesuffix(suffix) if suffix else t for t in self.labels]
        self.prefixes = {t[:k] for t in plain for k in range(1, len(t) + 1)}
        self.reach: dict[str, int] = {}  # the length of the longest token that begins with these four characters
        for t in plain:
            if len(t) > 3:
                self.reach[t[:4]] = max(self.reach.get(t[:4], 0), len(t))
        # tokens that end a word, by what is before the suffix; the start has lost no arc
        self.whole = {t.removesuffix(suffix): i for t, i in vocab.items() if t.endswith(suffix) and self.live[i]}

    def _gadget(self, u: int, v: int, w: int, time: int) -> None:
        if self.live[w] or not (self.live[u] and self.live[v]) or not self._allows(self.target[u], v):
            return  # the pair can't occur any more: this merge never applies
        after = self.target[v]
        self.owner.append(u)
        self.when.append(time)
        self.target[u] = self.gadgets[u * self._size + v] = len(self.owner) - 1
        self.left[w], self.born[w], self.target[w], self.origin[w], self.live[w] = u, time, after, after, True

    def _removed(self, state: int, token: int) -> int | None:
        """When a state, or one that it is a copy of, lost an arc."""
        while state:
            u = self.owner[state]
            gone = self.gadgets.get(u * self._size + token)
            if gone is not None and gone <= state:
                return self.when[gone]
            state = self.origin[u]
        return None

    def _allows(self, state: int, token: int) -> bool:
        if not self.live[token]:
            return False
        at = 1 << 60
        while True:
            gone = self._removed(state, token)
            if gone is not None and gone <= at:
                return False
            if self.left[token] < 0:
                return True
            at, token = self.born[token], self.left[token]

    def allows(self, state: int, token: int) -> bool:
        key = state * self._size + token
        known = self._known.get(key)
        if known is None:
            if len(self._known) > MEMO:
                self._known.clear()
            known = self._known[key] = self._allows(state, token)
        return known

    def encode(self, word: str) -> list[int]:
        """The accepted path of a word in the byte alphabet; its last symbol carries the end suffix."""
        t = self.whole.get(word)
        if t is not None:
            return [t]
        vocab, whole, target, reach, known, n = self.vocab, self.whole, self.target, self.reach, self._known, len(word)
        size = self._size
        path, ids, dead, i, q = [], [], set(), 0, 0
        k = min(n, reach.get(word[:4], 3))
        while True:
            while k:
                j = i + k
                t = whole.get(word[i:]) if j == n else vocab.get(word[i:j])
                if t is not None and j not in dead:
                    ok = known.get(q * size + t)
                    if self.allows(q, t) if ok is None else ok:
                        break
                k -= 1
            if k:
                ids.append(t)
                if j == n:
                    return ids
                path.append((i, q))
                i, q = j, target[t]
                k = reach.get(word[i : i + 4], 3)
                if k > n - i:
                    k = n - i
            elif path:
                dead.add(i)
                (j, q), _ = path.pop(), ids.pop()
                i, k = j, i - j - 1
            else:
                raise ValueError(f"no tokens for {word!r}")


class Memo(dict):
    """A function's values: those of the last MEMO arguments that weren't known, and of up to as many before these.

    A value that is asked for again is kept when the older ones go. Arguments of over 64 characters are not kept.
    """

    def __init__(self, function):
        super().__init__()
        self.function, self.older = function, {}

    def __missing__(self, x: str) -> bytes:
        got = self.older.get(x)
        if got is None:
            got = self.function(x)
            if len(x) > 64:
                return got
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        self[x] = got
        return got


class WordCodec:
    """Normalization, pre-splitting and added tokens around the automaton, with a bounded memo of whole words.

    Words are normalized and cut with Python's tables. Where these know less, or other, than the vocabulary's library (code
    points that Python's version of Unicode has not assigned: lower case, classes, compositions), the library's own
    normalizer and pre-split are asked; the automaton encodes the pieces all the same.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        library = Tokenizer.from_str(json.dumps({**spec, "model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}))
        self.normalize, self.presplit = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.automaton = MergeAutomaton(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {**dict(enumerate(self.automaton.labels)), **{i: t for t, i in self.added.items()}}
        self.label_array = np.array([labels.get(i, "") for i in range(max(labels, default=-1) + 1)], object)
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PIECES).findall
        self.ascii_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall  # the same, where there is no other character
        self.spaces = re.compile(f"[{SPACES}]+")
        self.odd = re.compile("[\x1c-\x1f]").search  # str.split() takes these for white space, the vocabulary doesn't
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.piece, self.words_known = Memo(self._piece), Memo(self._word)

    def split(self, word: str) -> list[str]:
        """Pieces of one word without white space, in the byte alphabet."""
        if word.isascii():
            word = word.lower()
            if word.isalpha():
                return [word]
            found = self.ascii_pieces(word)
            if word.isprintable():
                return found
        else:
            letters = word.isalpha()  # then all code points are assigned
            if not letters and "Cn" in map(unicodedata.category, word):
                return [p for p, _ in self.presplit(self.normalize(word))]
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
            found = [word] if letters and word.isalpha() else self.pieces(word)
        return [p.encode().decode("latin-1").translate(self.alphabet) for p in found]

    def _piece(self, piece: str) -> bytes:
        ids = self.automaton.encode(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        parts = [self.piece[p] for p in self.split(word)]
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def words(self, text: str):
        """(word, id of an added token or None) in text order."""
        parts = self.at_added.split(text) if self.at_added and "<|" in text else (text,)
        for part in parts:
            if (special := self.added.get(part)) is not None:
                yield part, special
            else:
                for w in part.split() if not self.odd(part) else filter(None, self.spaces.split(part)):
                    yield w, None

    def encode(self, text: str | None) -> tuple[int, bytes]:
        """(number of tokens, ids as little-endian 32 bits)."""
        text, word = text or "", self.words_known.__getitem__
        if "<|" in text or self.odd(text):
            ids = b"".join([word(w) if i is None else struct.pack("<I", i) for w, i in self.words(text)])
        else:
            ids = b"".join(map(word, text.split()))
        return len(ids) // 4, ids

    def release(self) -> None:
        """Give memory back when a task ends; the memo of words, which is bounded, serves the worker's next task."""
        self.piece = Memo(self._piece)
        self.automaton._known = {}

    def decode(self, ids: bytes) -> str:
        """Emit the labels of the arcs; the vocabulary's file names no decoder, so labels are joined by blanks."""
        return " ".join(self.label_array[np.frombuffer(ids, "<u4")].tolist())


@lru_cache(2)
def codec(raw: bytes) -> WordCodec:
    """One per worker process and vocabulary."""
    return WordCodec(raw)


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read by the driver and broadcast: its size is fixed, whatever the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def map_texts(df: DataFrame, text: str, fields: list[T.StructField], make, carry: list[str] | None = None):
    """df with columns appended: make() gives a function of a text, which returns their values, and one to call when a task ends.

    Columns of df that clash with the new ones are replaced; carry names the other columns to keep (all by default).
    Batches are cut after OUT_BYTES of text.
    """
    new = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new and (carry is None or f.name in carry)]
    # a text that is kept as it is goes to the worker once
    at = next((k for k, f in enumerate(keep) if f.name == text and f.dataType == T.StringType()), len(keep))
    own = [df[f"`{f.name}`"] for f in keep]
    src = df.select(*own, *[df[f"`{text}`"].cast("string").alias("__text__")] * (at == len(keep)))
    names, schema = [f.name for f in keep], T.StructType([*keep, *fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        (one, release), arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            texts, start, size, rows = batch.column(at), 0, 0, []
            for i in range(batch.num_rows):
                t = texts[i].as_py()
                rows.append(one(t))
                size += len(t or "")
                if size >= OUT_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    cols = [part.column(k).cast(arrow.field(k).type) for k in range(len(names))]
                    cols += [pa.array([r[k] for r in rows], arrow.field(len(names) + k).type) for k in range(len(fields))]
                    yield pa.RecordBatch.from_arrays(cols, schema=arrow)
                    start, size, rows = i + 1, 0, []
        release()

    return src.mapInArrow(run, schema)


def encode(df: DataFrame, tokenizer: str, text: str = "text", decoded: bool = True, carry: list[str] | None = None) -> DataFrame:
    """df, or its columns named by carry, with ``n_tokens`` long, ``ids`` binary (little-endian unsigned 32 bits) and, if asked for, ``decoded`` string: these ids decoded."""
    raw = vocabulary(df, tokenizer)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]

    def make():
        c = codec(raw.value)

        def both(t):
            n, ids = c.encode(t)
            return n, ids, c.decode(ids)

        return (both if decoded else c.encode), c.release

    return map_texts(df, text, fields if decoded else fields[:2], make, carry)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """df with ``decoded``: the labels of the ids, as the vocabulary's library joins them; null ids give null."""
    from pyspark.sql import functions as F

    raw = vocabulary(df, tokenizer)

    @F.pandas_udf("string")
    def spell(column):
        run = codec(raw.value).decode
        return column.map(lambda b: None if b is None else run(bytes(b)))

    return df.withColumn("decoded", spell(F.col(ids)))
