"""Substring dedup: recurring passages, confirmed and compiled into Aho-Corasick automata that stream over all documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import WORD, cut, drop_cut, freeing
from tidegauge.llm.textops import Words, mix64, runs, slices, utf8

#: Bytes of text to which one automaton belongs, about, and tasks that the automata are dealt to at most.
SHARD, TASKS = 8_000_000, 100_000
#: Keys under which more windows stand than HOT in one of SAMPLED documents are split; so many of them at most, half a megabyte.
SAMPLED, HOT, MOST_HOT = 32, 64, 65_536
#: Bytes of a window's own hash, which tells it apart from others under its key.
OWN = 6
_NULL = -(2**63)
_WORD = re.compile(WORD)


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    m, w = a, 1
    while 2 * w <= width:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    return np.minimum(m[: len(m) - (width - w)], m[width - w :]) if w < width else m


def _joined(doc: np.ndarray, *at: np.ndarray) -> np.ndarray:
    """Where runs begin: rows of another document, or of a place (in one of the columns `at`) that isn't the one after the row before."""
    new = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    for x in at:
        new[1:] |= x[1:] != x[:-1] + 1
    return np.flatnonzero(new)


def anchored(docs: DataFrame, window: int, hot: np.ndarray | None = None) -> DataFrame:
    """(key, doc, pos, hashes): the windows of every document, in runs that have the same key.

    A window's key is the smallest hash of the runs of about a third of its words inside it, so equal windows have equal keys,
    and a run of windows shares one: a row for about seven words. hashes: OWN bytes of each window's own hash. So windows that are told apart by nothing agree in 64 bits and in 48.

    Of windows that a slice of text holds more than once, only the first goes on under its key. The others are known by now to have an earlier equal; their rows have -1 - pos instead
    of pos, and as hashes the number of windows, and document and place of that first. So a copied text or passage sends no row for each copy to one key.
    hot: sorted keys under which many different windows stand (a common phrase before all kinds of text): each of their windows gets a key of its own.
    """
    third = max(1, round(0.35 * window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                words = Words(*utf8(batch.column("text")), lower=False)
                if len(words.hash) < window:
                    continue
                key, own = _sliding_min(runs(words.hash, third), window - third + 1), runs(words.hash, window)
                row = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
                at = np.flatnonzero(row[: len(key)] == row[window - 1 :])
                key, own, row = key[at], own[at], row[at]
                doc, pos = batch.column("doc").to_numpy(zero_copy_only=False)[row], at - words.first[:-1][row]
                order = np.argsort(own)
                same = own[order][1:] == own[order][:-1]
                some = order[np.r_[same, False] | np.r_[False, same]]  # the windows that are there more than once
                some = some[np.lexsort((pos[some], doc[some], own[some]))]
                new = np.r_[True, own[some][1:] != own[some][:-1]] if len(some) else np.zeros(0, bool)
                first = some[np.flatnonzero(new)][np.cumsum(new) - 1]
                later = (doc[some] > doc[first]) | ((doc[some] == doc[first]) & (pos[some] > pos[first]))
                some, first = some[later], first[later]
                back = np.argsort(some)
                some, first = some[back], first[back]
                cuts = _joined(row[some], some, pos[some], first, pos[first])
                # these rows go anywhere: their key only deals them out
                yield _rows(mix64(own[some[cuts]] ^ mix64((doc + pos)[some[cuts]].astype(np.uint64))), doc[some[cuts]], -1 - pos[some[cuts]], np.stack([np.diff(np.r_[cuts, len(some)]), doc[first[cuts]], pos[first[cuts]]], axis=1).astype(np.int64).view(np.uint8).reshape(len(cuts), 24), np.arange(len(cuts) + 1))
                rest = np.ones(len(key), bool)
                rest[some] = False
                key, own, row, doc, pos = key[rest], own[rest], row[rest], doc[rest], pos[rest]
                new = np.zeros(len(key), bool)
                new[_joined(row, pos)] = True
                new[1:] |= key[1:] != key[:-1]
                if hot is not None and len(hot):
                    split = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                    key = np.where(split, mix64(key ^ own), key)
                    new |= split
                    new[1:] |= split[:-1]
                new = np.flatnonzero(new)
                yield _rows(key[new], doc[new], pos[new], np.ascontiguousarray(own).view(np.uint8).reshape(-1, 8)[:, :OWN], np.r_[new, len(key)])

    return docs.mapInArrow(run, "key long, doc long, pos int, hashes binary")


def _rows(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, items: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Rows whose hashes are the items from first[i] to before first[i + 1], one after another."""
    offsets = (first * items.shape[1]).astype(np.int32)
    hashes = pa.BinaryArray.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(items).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(pos.astype(np.int32)), hashes], ["key", "doc", "pos", "hashes"])


def hot_keys(docs: DataFrame, window: int) -> np.ndarray:
    """The keys with the most different windows in a part of the documents, sorted. Which they are changes how windows are dealt out, never the result."""
    part = anchored(docs.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0), window).where("pos >= 0")
    top = part.groupBy("key").agg(F.sum(F.octet_length("hashes") / OWN).alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "key").limit(MOST_HOT)
    with freeing(docs.sparkSession):
        return np.sort(np.array([r.key for r in top.select("key").collect()], np.int64).view(np.uint64))


_FOUND = ["doc", "pos", "n", "first_doc", "first_pos"]


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of key, doc, pos: (doc, pos, n, first_doc, first_pos) for windows that have an earlier equal, in runs of n.

    What is carried over from a batch are the first windows of its last key; those of hot keys have keys of their own, so they are few.
    """
    carry_key, carry = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        known = np.flatnonzero(batch.column("pos").to_numpy() < 0)
        if len(known):
            b = batch.take(pa.array(known))
            x = np.frombuffer(b"".join(b.column("hashes").to_pylist()), np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(-1 - b.column("pos").to_numpy().astype(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], _FOUND)
            batch = batch.filter(pa.array(batch.column("pos").to_numpy() >= 0))
            if not batch.num_rows:
                continue
        key, doc, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc", "pos"))
        o = np.frombuffer(batch.column("hashes").buffers()[1], np.int32)[batch.column("hashes").offset :][: len(key) + 1]
        n = np.diff(o) // OWN
        wide = np.zeros((int(n.sum()), 8), np.uint8)
        wide[:, :OWN] = np.frombuffer(batch.column("hashes").buffers()[2], np.uint8)[o[0] : o[-1]].reshape(-1, OWN)
        own = wide.view(np.uint64).ravel()
        row = np.repeat(np.arange(len(key)), n)
        w_key, w_doc = key[row], doc[row].astype(np.int64)
        w_pos = pos[row].astype(np.int64) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        if carry is not None and carry_key == key[0]:
            w_key, own, w_doc, w_pos = (np.concatenate(x) for x in ((np.full(len(carry[0]), carry_key), w_key), (carry[0], own), (carry[1], w_doc), (carry[2], w_pos)))
            held = len(carry[0])
        else:
            held = 0
        order = np.lexsort((w_pos, w_doc, own, w_key))
        k, h = w_key[order], own[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])]
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # of each window in order, the earliest equal one
        of = np.empty(len(order), np.int64)
        of[order] = first
        last = w_key == key[-1]
        firsts = np.flatnonzero(last & (of == np.arange(len(of))))
        carry_key, carry = key[-1], (own[firsts], w_doc[firsts], w_pos[firsts])
        fd, fp = w_doc[of], w_pos[of]
        later = np.flatnonzero(((w_doc > fd) | (w_pos > fp)) & (np.arange(len(of)) >= held))
        if not len(later):
            continue
        d, p, fd, fp = w_doc[later], w_pos[later], fd[later], fp[later]
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1) | (fd[1:] != fd[:-1]) | (fp[1:] != fp[:-1] + 1)])
        size = np.diff(np.r_[new, len(d)])
        yield pa.RecordBatch.from_arrays([pa.array(d[new]), pa.array(p[new]), pa.array(size), pa.array(fd[new]), pa.array(fp[new])], _FOUND)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of doc and pos, those that go on where the row before ends, in the document and in the first one, become one."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "doc", "pos", "n", "first_doc", "first_pos")]
        if held is not None:
            x = [np.concatenate(([h], c)) for h, c in zip(held, x, strict=True)]
        s, d, p, n, fd, fp = x
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + n[:-1]) | (fd[1:] != fd[:-1]) | (fp[1:] != fp[:-1] + n[:-1])])
        size = np.add.reduceat(n, new)
        out = [s[new], d[new], p[new], size, fd[new], fp[new]]
        held = [c[-1] for c in out]
        if len(new) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1]) for c in (out[0], out[3], out[4], out[5])], ["shard", "n", "first_doc", "first_pos"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[i]]) for i in (0, 3, 4, 5)], ["shard", "n", "first_doc", "first_pos"])


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of docs (doc_id, text); kept: the words that stay, joined by a space.

    A word goes if a window of `window` consecutive words that covers it has the same words as one that starts
    earlier: in a smaller doc_id, or before it in the same document. Windows are judged on the input.

    1. Windows are hashed, and runs of them meet by key (see anchored); those with an earlier equal, consecutive ones merged, point to a
       passage of a document where it comes earlier: the first, or the first in the same slice of text.
    2. The passages' words are taken from those first documents: that confirms them, and a passage that only hashes alike is found nowhere.
    3. Documents are dealt into shards of about SHARD bytes. A shard's automaton holds the distinct passages that its documents point to, as sequences of words, each with
       its first place; the shard's documents stream through it, and every occurrence but the first loses its words.

    Null text: no words. Empty or shorter texts lose nothing. A null doc_id counts as smaller than all others.
    Rows that share a doc_id: a window isn't earlier than one at the same place of another such row. An empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    shards = max(1, -(-int(size) // SHARD))
    shard = F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int")
    met = anchored(base, window, hot_keys(base, window)).repartition("key").sortWithinPartitions("key", "doc", "pos")
    found = cut(met.mapInArrow(_recurring, "doc long, pos long, n long, first_doc long, first_pos long"), "recurring")
    runs_of = found.withColumn("shard", shard.cast("long")).repartition("doc").sortWithinPartitions("doc", "pos")
    passages = cut(runs_of.mapInArrow(_merged, "shard long, n long, first_doc long, first_pos long").distinct(), "passages")
    drop_cut(found)
    texts = _phrases(base, passages.select("first_doc", "first_pos", "n").distinct(), window)
    phrases = cut(texts.join(passages, ["first_doc", "first_pos", "n"]).select(F.col("shard").cast("int"), F.lit(0).alias("kind"), F.col("first_doc").alias("doc"), F.col("first_pos").alias("pos"), F.col("phrase").alias("text")), "phrases")
    drop_cut(passages)
    both = phrases.unionByName(base.select(shard.alias("shard"), F.lit(1).alias("kind"), "doc", F.lit(0).cast("long").alias("pos"), "text"))
    tasks = min(shards, TASKS)
    both = both.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("shard", "kind")
    out = both.mapInArrow(_locate, "doc long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("doc") != _NULL, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept")


def _phrases(base: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(first_doc, first_pos, n, phrase): the words of each passage. A document's passages are a list, no longer than its words, that joins its text: one shuffle of the texts, by sort and merge whatever the size."""
    lists = asked.groupBy(F.col("first_doc").alias("doc")).agg(F.collect_list(F.struct("first_pos", "n")).alias("ranges"))
    rows = base.join(lists.hint("merge"), "doc").select("doc", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, text, ranges in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("ranges"), strict=True):
                words = _WORD.findall(text.as_py())
                # with rows that share a doc_id, a range may lie beyond this one's end
                at = [(x["first_pos"], x["n"]) for x in ranges.as_py()]
                out += [{"first_doc": d, "first_pos": a, "n": m, "phrase": " ".join(words[a : a + m + window - 1])} for a, m in at if a + m + window - 1 <= len(words)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("first_doc", pa.int64()), ("first_pos", pa.int64()), ("n", pa.int64()), ("phrase", pa.string())]))

    return rows.mapInArrow(run, "first_doc long, first_pos long, n long, phrase string")


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of shard and kind: phrases of a shard, which are compiled, then its documents, which stream through."""
    shard, ids, places, automaton = None, {}, {}, None
    for batch in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for s, kind, doc, pos, text in zip(*(batch.column(c) for c in ("shard", "kind", "doc", "pos", "text")), strict=True):
            if (now := s.as_py()) != shard:
                shard, ids, places, automaton = now, {}, {}, None
            words = _WORD.findall(text.as_py())
            if kind.as_py() == 0:
                # a phrase that several documents hold has one earliest place
                key, place = tuple(ids.setdefault(w, len(ids) + 1) for w in words), (doc.as_py(), pos.as_py())
                if places.get(key, place) >= place:
                    places[key] = place
                continue
            if places:
                automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
                for key, place in places.items():
                    automaton.add_word(key, (len(key), place))
                automaton.make_automaton()
                places = {}
            d, gone = doc.as_py(), None
            if automaton is not None and words:
                for end, (n, place) in automaton.iter(tuple([ids.get(w, 0) for w in words])):
                    if (d, end + 1 - n) > place:
                        gone = bytearray(len(words)) if gone is None else gone
                        gone[end + 1 - n : end + 1] = b"\1" * n
            removed = sum(gone) if gone else 0
            kept = [w for w, g in zip(words, gone, strict=True) if not g] if removed else words
            for c, v in zip(out, (d, len(words), removed, " ".join(kept)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["doc", "n_words", "n_removed", "kept"])
