"""Substring dedup by seeds and extension: winnowed anchors, joined; matches extended word by word.

A repeat is a run of at least ``size`` words that also starts elsewhere, in the same document or another. Every run
of ``size`` words holds a winnowed anchor: of each ``size - SEED + 1`` neighbouring word ``SEED``-grams the one with
the smallest hash (all of them, on ties) is taken, so equal runs hold equal anchors at equal places. Hence

1. documents with equal words are one: if they repeat and have a run at all, all their words go, and one of them
   stands for the others;
2. anchors found once are set aside; the rest are the seeds;
3. the occurrence with the smallest key is the seed's leader. Around each seed a document's words are kept as far as
   a run that holds the seed can reach; each other occurrence is joined with its leader and extended to both sides
   while the words agree. What agrees over ``size`` words or more is a maximal repeat with the leader, and both ends'
   words are marked;
4. runs in which an occurrence does not agree with its leader can only agree with those of a third one: equality of
   runs is transitive. Equal runs hold the same smallest gram (the leftmost on ties) at the same place, which is an
   anchor of each of them whatever words stand around; other anchors inside a run depend on the words before and after
   it. Where a seed has three occurrences or more, the hashes of the runs that do not agree with the leader there and
   have their smallest gram there are counted, and those that meet again are marked too.

A passage in a third of all documents thus costs one row for each of its anchors and documents, never a pair of
documents, and sums by hash are taken before rows are shuffled. Joins on a common seed are split by adaptive
execution. Words are told apart by 64-bit hashes, in the extension by 40 bits of them. A null or empty text has no words; repeated rows are repeats of each
other; rows that agree in id and text get the same marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import documents, prepare, row_key, shared_folder, stored
from tapeloom.llm.text import chunks, utf8, window_hashes, words

SIZE, SEED = 35, 12
NONE = np.uint64(0)
#: Occurrences of a seed: its leader, the other one of two, one of three or more.
LEADER, OTHER, CROWD = 0, 1, 2


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def anchors(word_hash: np.ndarray, first: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (first word) and hashes of the anchors of several texts."""
    grams = window_hashes(word_hash, seed)
    reach = size - seed + 1
    if len(word_hash) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.maximum(grams, np.uint64(1))
    least = sliding(grams, reach, np.minimum)  # of the run of ``size`` words that starts here
    least = np.where(inside(first, len(least), size), least, NONE)
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
    chosen = np.flatnonzero(sliding(padded, reach, np.maximum) == grams)
    return chosen, grams[chosen]


def inside(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether the run of ``size`` words from each of the first n words ends in its text."""
    ends = np.repeat(first[1:], np.diff(first))
    return (np.arange(n) + size <= ends[:n]) if n else np.zeros(0, bool)


def sketches(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """doc_id, row_key, n_words, whole1 and whole2 (hash of all words), places and hashes of the anchors."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in chunks(batch.column(1)):
                w = words(data, at)
                place, key = anchors(w.hash, w.first, size, seed)
                cuts = np.searchsorted(place, w.first)
                place = place - np.repeat(w.first[:-1], np.diff(cuts))
                whole = [xxhash.xxh3_128_digest(w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                halves = np.frombuffer(b"".join(whole), "<i8").reshape(-1, 2)
                part = batch.slice(row, len(at) - 1)
                offsets = pa.array(cuts.astype(np.int32))
                yield pa.record_batch(
                    [part.column(0), part.column(2), pa.array(w.counts), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(key.view(np.int64)))],
                    names=["doc_id", "row_key", "n_words", "whole1", "whole2", "places", "anchors"],
                )

    return docs.select("doc_id", "text", row_key()).mapInArrow(sketch, "doc_id long, row_key long, n_words long, whole1 long, whole2 long, places array<int>, anchors array<long>")


def contexts(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """One row for each seed of a document: the words on both sides as far as a run that holds the seed can reach.

    ``docs`` has row_key, text and seeds (place, kind). The runs whose smallest gram (the leftmost on ties) is this
    seed start ``fewest`` to ``most`` words before it; there are none if ``most`` is less than ``fewest``.
    """
    reach = size - seed

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in chunks(batch.column(1)):
                w = words(data, at)
                part = batch.slice(row, len(at) - 1)
                lists = part.column(2)
                count = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(len(at) - 1), count)
                entries = lists.flatten()
                place, kind = (entries.field(k).to_numpy() for k in (0, 1))
                order = np.lexsort((place, doc))
                doc, place, kind = doc[order], place[order].astype(np.int64), kind[order]
                left = np.minimum(place, reach)
                right = np.minimum(w.counts[doc] - place, size)
                start, length = w.first[doc] + place - left, left + right
                cuts = np.concatenate([[0], np.cumsum(length)])
                spread = np.repeat(start - cuts[:-1], length) + np.arange(cuts[-1])
                short = w.hash >> np.uint64(24)
                low, high = short.astype(np.uint32).view(np.int32)[spread], (short >> np.uint64(32)).astype(np.uint8)[spread]
                ends = pa.array(cuts.astype(np.int32))
                whole = [pa.ListArray.from_arrays(ends, pa.array(low)), pa.BinaryArray.from_buffers(pa.binary(), len(place), [None, ends.buffers()[1], pa.py_buffer(high.tobytes())])]
                grams = window_hashes(w.hash, seed)
                grams = np.maximum(grams, np.uint64(1))
                at_seed = w.first[doc] + place
                anchor = grams[at_seed] if len(place) else np.zeros(0, np.uint64)
                most = _larger(grams, at_seed, -1, left, np.greater)
                fewest = np.maximum(size - right, reach - _larger(grams, at_seed, 1, np.minimum(w.counts[doc] - place - seed, reach), np.greater_equal))
                yield pa.record_batch(
                    [pa.array(anchor.view(np.int64)), part.column(0).take(pa.array(doc)), pa.array(place.astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(fewest.astype(np.int32)), pa.array(most.astype(np.int32)), pa.array(kind), *whole],
                    names=["anchor", "row_key", "place", "left", "fewest", "most", "kind", "low", "high"],
                )

    return docs.select("row_key", "text", "seeds").mapInArrow(around, "anchor long, row_key long, place int, left int, fewest int, most int, kind byte, low array<int>, high binary")


def _larger(grams: np.ndarray, at: np.ndarray, step: int, limit: np.ndarray, larger) -> np.ndarray:
    """How many grams in a row before (step -1) or after (1) each place are ``larger`` than its own, up to ``limit``."""
    reached, going = np.zeros(len(at), np.int64), np.arange(len(at))
    for k in range(1, int(limit.max(initial=0)) + 1):
        going = going[limit[going] >= k]
        going = going[larger(grams[at[going] + step * k], grams[at[going]])]
        reached[going] += 1
    return reached


def _words(low: pa.ListArray, high: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The words of several contexts, and where each begins."""
    flat, _ = utf8(high)
    values = low.flatten().to_numpy().view(np.uint32).astype(np.uint64) | (flat.astype(np.uint64) << np.uint64(32))
    return values, np.concatenate([[0], np.cumsum(np.diff(low.offsets.to_numpy()))])


def extended(pairs: DataFrame, size: int) -> DataFrame:
    """Each occurrence against its leader: ``mine`` and ``its`` are the places (start, end) of the repeat in both, or
    null; ``open`` are the starts and hashes of the runs with this seed as smallest gram that do not agree."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    rest = pa.struct([("start", pa.int32()), ("run", pa.int64())])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = {k: batch.column(k).to_numpy() for k in ("place", "left", "fewest", "most", "lead_place", "lead_left")}
            (a, a_off), (b, b_off) = (_words(batch.column(f"{side}low"), batch.column(f"{side}high")) for side in ("", "lead_"))
            left, lead_left = cols["left"].astype(np.int64), cols["lead_left"].astype(np.int64)
            right, lead_right = np.diff(a_off) - left, np.diff(b_off) - lead_left
            a_seed, b_seed = a_off[:-1] + left, b_off[:-1] + lead_left
            back, ahead = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for step, reached, limit in ((-1, back, np.minimum(left, lead_left)), (1, ahead, np.minimum(right, lead_right))):
                going = np.arange(n)
                for k in range(int(limit.max())):
                    going = going[limit[going] > k]
                    shift = -1 - k if step < 0 else k
                    going = going[a[a_seed[going] + shift] == b[b_seed[going] + shift]]
                    reached[going] += 1
            found = back + ahead >= size
            place, lead_place = cols["place"].astype(np.int64), cols["lead_place"].astype(np.int64)
            spans = [
                pa.StructArray.from_arrays([pa.array((p - back).astype(np.int32)), pa.array((p + ahead).astype(np.int32))], fields=list(span), mask=pa.array(~found))
                for p in (place, lead_place)
            ]
            runs = window_hashes(a, size)
            fewest = cols["fewest"].astype(np.int64)
            count = np.where(batch.column("kind").to_numpy() == CROWD, np.maximum(0, cols["most"] - fewest + 1), 0)
            owner = np.repeat(np.arange(n), count)
            off = np.repeat(fewest, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            agree = found[owner] & (off <= back[owner]) & (size - off <= ahead[owner])
            owner, off = owner[~agree], off[~agree]
            values = pa.StructArray.from_arrays([pa.array((place[owner] - off).astype(np.int32)), pa.array(runs[a_seed[owner] - off].view(np.int64))], fields=list(rest))
            offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
            yield pa.record_batch(
                [batch.column("row_key"), batch.column("lead_key"), spans[0], spans[1], pa.ListArray.from_arrays(offsets, values)],
                names=["row_key", "lead_key", "mine", "its", "open"],
            )

    return pairs.mapInArrow(extend, "row_key long, lead_key long, mine struct<start:int,end:int>, its struct<start:int,end:int>, open array<struct<start:int,run:long>>")


def repeats(docs: DataFrame, size: int = SIZE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows with ``twin``: whether another row has the same words; spans: row_key and the marked
    spans of each text that stands for itself), both stored."""
    spark = prepare(docs.sparkSession)
    folder = shared_folder(spark)
    rows = documents(docs, id_col, text_col)
    known = stored(sketches(rows, size, seed), folder, "sketches")
    groups = known.where(F.col("n_words") >= size).groupBy("whole1", "whole2").agg(F.min("row_key").alias("row_key"), F.count("*").alias("copies"))
    ones = stored(groups, folder, "groups")
    single = known.join(ones.select("row_key"), "row_key", "left_semi")
    placed = single.select("row_key", F.explode(F.arrays_zip("anchors", "places")).alias("a")).select("row_key", F.col("a.anchors").alias("anchor"), F.col("a.places").alias("place"))
    again = placed.groupBy("anchor").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "place")).alias("lead")).where("n > 1")
    kind = F.when(F.struct("row_key", "place") == F.col("lead"), LEADER).when(F.col("n") == 2, OTHER).otherwise(CROWD).cast("byte").alias("kind")
    seeds = stored(placed.join(again, "anchor").groupBy("row_key").agg(F.collect_list(F.struct("place", kind)).alias("seeds")), folder, "seeds")
    texts = rows.withColumn("row_key", row_key()).select("row_key", "text")
    # a repeated row brings its text more than once; all its words go anyway
    around = stored(contexts(texts.join(seeds, "row_key"), size, seed), folder, "contexts")
    lead = around.where(F.col("kind") == LEADER).select("anchor", F.col("row_key").alias("lead_key"), F.col("place").alias("lead_place"), F.col("left").alias("lead_left"), F.col("low").alias("lead_low"), F.col("high").alias("lead_high"))
    met = stored(extended(around.where(F.col("kind") != LEADER).join(lead, "anchor"), size), folder, "extended")
    both = met.where("mine is not null").select("row_key", "mine").union(met.where("mine is not null").select("lead_key", "its")).select("row_key", F.col("mine.start").alias("start"), F.col("mine.end").alias("end"))
    return known, stored(_gathered(both.union(_rest(met, size))), folder, "spans")


def _rest(met: DataFrame, size: int) -> DataFrame:
    """Spans of the runs that agree with no leader but with each other; a run that meets only itself, by a leader
    that is there more than once, is none."""
    runs = met.select("row_key", F.explode("open").alias("o")).select("row_key", "o.run", "o.start")
    at = F.struct("row_key", "start")
    again = runs.groupBy("run").agg(F.min(at).alias("one"), F.max(at).alias("two")).where("one <> two").select("run")
    return runs.join(again, "run").select("row_key", "start", (F.col("start") + size).alias("end"))


def _gathered(spans: DataFrame) -> DataFrame:
    """The distinct spans of each text: at most two for each of its words."""
    return spans.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def dedup_substrings(docs: DataFrame, size: int = SIZE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, text (the words that stay, joined by one space)."""
    known, spans = repeats(docs, size, seed, id_col, text_col)
    copied = known.where(F.col("n_words") >= size).groupBy("whole1", "whole2").agg(F.count("*").alias("copies")).where("copies > 1").select("whole1", "whole2")
    twins = known.join(copied, ["whole1", "whole2"]).select("row_key", F.lit(True).alias("all_gone")).dropDuplicates(["row_key"])
    marks = spans.join(twins, "row_key", "full").select("row_key", "spans", F.coalesce("all_gone", F.lit(False)).alias("all_gone"))
    rows = documents(docs, id_col, text_col).withColumn("row_key", row_key())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans").to_pylist()
            everything = batch.column("all_gone").to_pylist()
            for row, data, at in chunks(batch.column("text")):
                w, whole = words(data, at), data.tobytes()
                out, gone = [], []
                for k in range(len(at) - 1):
                    a, b = int(w.first[k]), int(w.first[k + 1])
                    change = np.zeros(b - a + 1, np.int32)
                    for s in lists[row + k] or ():
                        change[s["start"]] += 1
                        change[s["end"]] -= 1
                    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0) + a if not everything[row + k] else np.zeros(0, np.int64)
                    out.append(b" ".join([whole[x:y] for x, y in zip(w.begin[stay].tolist(), w.end[stay].tolist(), strict=True)]))
                    gone.append(b - a - len(stay))
                part = batch.slice(row, len(at) - 1)
                yield pa.record_batch([part.column("doc_id"), pa.array(w.counts), pa.array(gone, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    marked = rows.join(marks, "row_key", "left").select("doc_id", "text", "spans", "all_gone")
    return marked.mapInArrow(keep, "doc_id long, n_words long, n_removed long, text string")


def substring_digest(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
