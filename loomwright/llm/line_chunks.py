"""Operator 4: line dedup by content-defined line chunks.

A text's lines are hashed, and a rolling hash over the last WINDOW line hashes marks boundaries: a chunk ends after a line
where the rolling hash is 0 modulo DIVISOR, or after LONGEST lines. Boundaries depend on nearby lines only, so inserted or
deleted lines shift them for a few lines at most. Chunks of at least LEAST_LINES lines with a word are candidates.

A passage can lie between two boundaries, so chunks are cut by words too: from each line with words, the fewest lines on
from it that hold over PASSAGE words, and the fewest that do so back from it (one line if it is that long). They depend on
their own lines alone. Of a passage of over PASSAGE words, in however few lines, these overlap and cover every line from
its first to its last one with words, so matches grow line by line to the whole passage and no further.

All are counted over all documents by a 64-bit hash and their length; the candidates' bytes are then compared. Of each
repeated chunk, the first occurrence stays (smallest doc_id, then place) and all others are removed, wherever they stand;
where a later one overlaps the first, only the lines after the first go. Each line that goes has an equal line before it
that stays.

Only hashes are shuffled for the count. Text moves once: repeated chunks for the byte comparison, and documents, by key,
to meet their removals. A chunk that a third of all documents hold is aggregated before its shuffle, and its occurrences
meet its first one in a join that Spark may split.

Where the repeated hashes are too many to broadcast, chunks' places are joined with them, and then with the texts.

Results by case: null texts stay null, empty texts empty; a text all of whose chunks go becomes empty and its row stays;
rows that agree in doc_id and text are one document and keep the same lines; null ids are a document of their own, after
all others; no line terminator is added or lost inside kept text; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.base import fresh, stored

WINDOW, DIVISOR, LONGEST, LEAST_LINES = 2, 3, 32, 2
#: Chunks shorter than this are no passages and stay.
LEAST_WORDS = 8
#: Every passage of whole lines with more words than this is found.
PASSAGE = 50


def cut(lines: list[str], hashes: np.ndarray, window: int = WINDOW, divisor: int = DIVISOR, longest: int = LONGEST) -> list[int]:
    """Chunk ends (line numbers, exclusive)."""
    rolling = np.zeros(len(lines), np.uint64)
    for i in range(min(window, len(lines))):  # a polynomial in the last lines' hashes
        rolling[i:] += hashes[: len(lines) - i] * np.uint64(pow(0x100000001B3, i + 1, 1 << 64))
    rolling ^= rolling >> np.uint64(31)
    marks = np.flatnonzero(rolling % np.uint64(divisor) == 0) + 1
    ends, last = [], 0
    for m in [*marks.tolist(), len(lines)]:
        while m - last > longest:
            last += longest
            ends.append(last)
        if m > last:
            ends.append(m)
            last = m
    return ends


def runs(words: list[int], most: int = PASSAGE) -> set[tuple[int, int]]:
    """Least runs of lines with over most words that start or end at each line with words, from the lines' numbers of words."""
    at, out = [i for i, n in enumerate(words) if n], set()
    total, j = 0, 0
    for i in at:
        while j < len(at) and total <= most:
            total += words[at[j]]
            j += 1
        if total <= most:
            break
        out.add((i, at[j - 1] + 1))
        total -= words[i]
    total, j = 0, 0
    for i in at:
        total += words[i]
        while total - words[at[j]] > most:
            total -= words[at[j]]
            j += 1
        if total > most:
            out.add((at[j], i + 1))
    # blank lines between two that are long enough alone
    out.update((i, j + 1) for i, j in zip(at, at[1:]) if j > i + 1 and words[i] > most and words[j] > most)
    return out


CHUNKS = "doc_id long, digest long, first int, last int, hash long, size int"
#: Up to so many distinct hashes (8 bytes each) are broadcast, after they are counted; more are joined.
BROADCAST = 4_000_000


def chunk_rows(rows: DataFrame, only=None, bodies: bool = False) -> DataFrame:
    """Chunks of (doc_id, digest, text) rows that may be removed, or those with the broadcast hashes; with bodies, their text."""

    def run(batches):
        import xxhash

        one = xxhash.xxh3_64_intdigest
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()] + [pa.string()] * bodies
        names = ["doc_id", "digest", "first", "last", "hash", "size"] + ["body"] * bodies
        among = np.sort(only.value) if only is not None else None
        record = lambda out: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)
        for batch in batches:
            ids, digests, texts, out, held = batch.column(0), batch.column(1), batch.column(2), [], 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if not text:
                    continue
                lines = text.split("\n")
                words, hashes = [len(x.split()) for x in lines], np.array([one(x) for x in lines], np.uint64)
                spans, start = runs(words), 0
                for end in cut(lines, hashes) if len(lines) >= LEAST_LINES else ():
                    if end - start >= LEAST_LINES and sum([bool(x.strip(" \t\n\x0b\f\r")) for x in lines[start:end]]) >= LEAST_LINES and sum(words[start:end]) >= LEAST_WORDS:
                        spans.add((start, end))
                    start = end
                if not spans:
                    continue
                raw, d, digest = hashes.tobytes(), ids[i].as_py(), digests[i].as_py()
                until = list(accumulate(map(len, lines), initial=0))
                found = [(d, digest, x, y, one(raw[8 * x : 8 * y], 9) - (1 << 63), until[y] - until[x] + y - x - 1) for x, y in sorted(spans)]
                if among is not None:
                    h = np.array([r[4] for r in found], np.int64)
                    place = np.minimum(np.searchsorted(among, h), len(among) - 1)
                    found = [r for r, ok in zip(found, (among[place] == h).tolist() if len(among) else [False] * len(h)) if ok]
                for r in found:
                    out.append((*r, "\n".join(lines[r[2] : r[3]])) if bodies else r)
                    held += r[5] if bodies else 48
                    if held > 4 << 20:
                        yield record(out)
                        out, held = [], 0
            yield record(out)

    return rows.mapInArrow(run, CHUNKS + (", body string" if bodies else ""))


def repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of lines to remove, apart from each other: ``doc_id, digest`` (of the text), ``first, last`` (line numbers)."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("digest"), F.col(f"`{text}`").cast("string").alias("text"))
    same = ["hash", "size"]
    often = stored(chunk_rows(rows).groupBy(*same).agg(F.count("*").alias("c")).where("c > 1").select(*same), "often")
    if often.count() <= BROADCAST:
        hashes = np.array([r.hash for r in often.select("hash").toLocalIterator()], np.int64)
        bodies = chunk_rows(rows, docs.sparkSession.sparkContext.broadcast(hashes), bodies=True)
    else:
        places = chunk_rows(rows).join(often, same, "left_semi").distinct()
        places = places.groupBy(F.col("doc_id").alias("d"), F.col("digest").alias("x")).agg(F.collect_list(F.struct("first", "last", *same)).alias("g"))
        found = rows.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("x"))).select("doc_id", "digest", F.split("text", "\n").alias("l"), F.explode("g").alias("g"))
        bodies = found.select("doc_id", "digest", "g.*", F.array_join(F.slice("l", F.col("g.first") + 1, F.col("g.last") - F.col("g.first")), "\n").alias("body"))
    # rows that agree in doc_id and text are one document, so their equal chunks count once
    bodies = stored(bodies, "bodies")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "digest", F.col("first").alias("f"))
    # bytes are compared by grouping and joining on the text itself: equal hashes of different texts fall apart here
    firsts = stored(bodies.groupBy(*same, "body").agg(F.min(order).alias("o"), F.max(order).alias("z")).where("o < z").select(*same, "body", "o"), "firsts")
    later = bodies.join(firsts, [*same, "body"]).where(order > F.col("o"))
    own = F.col("o.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("o.digest") == F.col("digest"))
    first = F.when(own, F.greatest("first", F.col("o.f") + F.col("last") - F.col("first"))).otherwise(F.col("first"))
    spans = later.select("doc_id", "digest", first.alias("first"), "last").where("first < last").distinct()
    # chunks that overlap or meet become one
    before = Window.partitionBy("doc_id", "digest").orderBy("first", "last")
    ended = F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("first") <= ended, 0).otherwise(1))
    spans = spans.withColumn("k", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "digest", "k").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("k")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated chunks removed from the text, and ``n_removed_chunks`` (runs of lines) and ``n_removed_lines`` long."""
    out = ["n_removed_chunks", "n_removed_lines"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in out])
    d, x, gone = fresh(docs, "key", "digest", "gone")
    per = repeated_chunks(docs, key, text).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("first", "last")).alias(gone)).withColumnsRenamed({"doc_id": d, "digest": x})
    body = F.col(f"`{text}`")
    joined = docs.join(per, F.col(f"`{key}`").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(body) == F.col(x)), "left")
    kept = F.array_join(F.filter(F.split(body, "\n"), lambda line, i: ~F.exists(gone, lambda g: (i >= g["first"]) & (i < g["last"]))), "\n")
    lines = F.aggregate(gone, F.lit(0).cast("long"), lambda a, g: a + g["last"] - g["first"])
    return joined.withColumns({text: F.when(F.col(gone).isNull(), body).otherwise(kept), out[0]: F.coalesce(F.size(gone), F.lit(0)).cast("long"), out[1]: F.coalesce(lines, F.lit(0)).cast("long")}).withColumn(out[0], F.greatest(F.col(out[0]), F.lit(0).cast("long"))).drop(d, x, gone)
