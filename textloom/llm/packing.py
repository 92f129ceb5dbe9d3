"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Pieces differ for the packer only by their length, and a piece has one of at most
``capacity`` lengths. So the packer works on the histogram of lengths: one bin pattern
at a time (fill greedily; then swap the bin's smallest document for two unpacked ones
that fit its expanded gap more tightly), applied to as many bins as the counts allow.
The histogram has at most ``capacity`` rows whatever the corpus holds; pieces then find
their place by their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common

CAPACITY = 4096
END = 1
CACHE = 400_000
#: Words that stay in the cache between tasks.
KEPT = 50_000
#: Marks that form one unit of their own after the letters of a word; an apostrophe may not.
MARKS = "#$%&*!.,;:?|<>()"
TOKENIZER = "word_bpe_49k.json"
#: Longer words do not stay in the cache.
LONG = 200
LATIN = re.compile(r"[A-Za-zÀ-\u024F]+")


def plain_letters(word: str) -> bool:
    """Latin letters that lower-casing leaves one letter each and that no normal form changes."""
    return bool(LATIN.fullmatch(word)) and word.isalpha() and len(low := word.lower()) == len(word) and low.isalpha()


class WordEncoder:
    """Ids of whole texts by a public tokenizer that drops white space between words.

    No id of such a tokenizer spans white space, so a text's ids are its words' ids in order.
    Words seen before come from a bounded cache; new ones go through the tokenizer together.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        from tokenizers.pre_tokenizers import ByteLevel

        # a plain letter as the model sees it: a letter for each of its bytes
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = sorted({c.lower() for c in map(chr, range(ord("A"), 0x250)) if plain_letters(c)})  # some lie beyond the range
        self.letters = {ord(c): "".join(x for x, _ in level.pre_tokenize_str(c)) for c in letters}
        self.model = self.tokenizer.model
        # does the model alone give what the whole tokenizer gives for plain letters?
        probes = [*letters, "".join(letters)]
        self.direct = dict(self._whole(probes)) == dict(self._by_model(probes))
        self.cache: dict[str, bytes] = {"": b""}
        self.limit = cache

    def _whole(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for word, got in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            yield word, np.asarray(got.ids, "<u4").tobytes()

    def _by_model(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words of plain lower-case letters: each is one unit that no step before the model changes."""
        tokenize, letters = self.model.tokenize, self.letters
        for word in words:
            yield word, array("I", [t.id for t in tokenize(word if word.isascii() else word.translate(letters))]).tobytes()

    def _learn(self, words: Iterable[str]) -> None:
        """Ids of ``words`` into the cache; they do not hang on what it holds already.

        Only plain letters with marks behind are put together from two parts: the letters are one
        unit of the tokenizer and the marks another. Every other word goes through it whole.
        """
        known = self.cache
        parts: list[tuple[str, str, str]] = []
        new: set[str] = set()
        whole: set[str] = set()
        for word in words:
            base = word.rstrip(MARKS)
            if not (base.isalpha() and (base.isascii() or plain_letters(base))):
                whole.add(word)
                continue
            low = base.lower()
            if low not in known:
                new.add(low)
            if low != word:
                mark = word[len(base) :]
                parts.append((word, low, mark))
                if mark not in known:
                    whole.add(mark)
        known.update(self._whole(list(whole)))
        if new:
            known.update((self._by_model if self.direct else self._whole)(list(new)))
        for word, low, mark in parts:
            known[word] = known[low] + known[mark] if mark else known[low]

    def shrink(self, words: int) -> None:
        """Forget all but ``words`` words; those met early are the frequent ones."""
        self.cache = {"": b""} | dict(islice(self.cache.items(), words))

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text has none."""
        if len(self.cache) > self.limit:
            self.shrink(self.limit // 2)
        ids = self.cache
        rows: list[tuple[list, list[int], list[str]]] = []
        new: set[str] = set()
        for text in texts:
            words = (text or "").replace("\n", " ").split(" ")
            got = list(map(ids.get, words))
            gaps = [k for k, x in enumerate(got) if x is None]
            missing = [words[k] for k in gaps]
            new.update(missing)
            rows.append((got, gaps, missing))
        if new:
            self._learn(new)
        for got, gaps, missing in rows:
            for k, word in zip(gaps, missing, strict=True):
                got[k] = ids[word]
            yield b"".join(got)
        for word in new:
            if len(word) > LONG:  # text without spaces would fill the cache with bytes
                del ids[word]


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task with its cache."""
    import sys
    import types

    state = sys.modules.setdefault("textloom_worker_state", types.ModuleType("textloom_worker_state"))
    if getattr(state, "path", None) != path:
        state.path, state.encoder = path, WordEncoder(path)
    return state.encoder


def encoded_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids where asked for).

    A document is its ids and then ``end``; only documents over ``capacity`` are cut.
    Null and empty texts are the single id ``end``. Other columns are not carried.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        close = np.asarray([end], "<u4").tobytes()
        for batch in common.slices(batches, 256):
            keys, part, start, length, crc, ids = [], [], [], [], [], []
            for key, raw in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1).to_pylist()), strict=True):
                raw += close
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    keys.append(key)
                    part.append(k)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<i4"))
            columns = [pa.array(keys, batch.schema.field(0).type), pa.array(part, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        # the worker outlives its task beside whatever runs next
        encoder.shrink(KEPT)
        common.release_memory()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def plan_bins(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Best-two-fit over a histogram. Returns interval rows sorted by (length, first).

    A row says: pieces of ``length`` with ranks from ``first`` on, ``each`` a bin, go to the
    bins from ``bin`` on, at ``offset``. Every bin pattern is used as often as the counts
    allow, so a step uses up at least one length's whole multiples, and the rows are bounded
    by the capacity and not by the corpus.
    """
    left = np.zeros(capacity + 1, np.int64)
    left[lengths] = counts
    used = np.zeros(capacity + 1, np.int64)
    rows, bins = [], 0
    while True:
        live = np.flatnonzero(left)
        if not len(live):
            break
        take: dict[int, int] = {}
        gap = capacity
        top = int(live[-1])
        while gap:
            at = np.searchsorted(live, min(gap, top), "right") - 1
            while at >= 0 and left[live[at]] - take.get(int(live[at]), 0) <= 0:
                at -= 1
            if at < 0:
                break
            size = int(live[at])
            n = min(gap // size, int(left[size]) - take.get(size, 0))
            take[size] = take.get(size, 0) + n
            gap -= n * size
        if gap and len(take) + sum(take.values()) > 2:
            least = min(take)
            room = gap + least
            free = left.copy()
            for size, n in take.items():
                free[size] -= n
            first = np.flatnonzero(free[: room + 1] > 0)
            first = first[first > 0]
            best, pair = least, None
            if len(first):
                # for each first length the largest second that still fits; below that one, if it is the only one of its kind
                second = first[np.maximum(np.searchsorted(first, room - first, "right") - 1, 0)]
                sums = np.where((first + second <= room) & ((first != second) | (free[first] > 1)), first + second, 0)
                at = int(sums.argmax())
                if sums[at] > best:
                    pair = (int(first[at]), int(second[at]))
            if pair:
                take[least] -= 1
                if not take[least]:
                    del take[least]
                for size in pair:
                    take[size] = take.get(size, 0) + 1
        times = min(int(left[size]) // n for size, n in take.items())
        offset = 0
        for size in sorted(take, reverse=True):
            n = take[size]
            rows.append((size, int(used[size]), n, bins, offset))
            used[size] += n * times
            left[size] -= n * times
            offset += n * size
        bins += times
    table = np.asarray(sorted(rows), np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "first": table[:, 1], "each": table[:, 2], "bin": table[:, 3], "offset": table[:, 4], "bins": np.asarray([bins])}


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    ``pieces`` is read three times and should be materialised. Repeated rows each get a
    place of their own. An empty table gives an empty result.
    """
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    plan = plan_bins(np.asarray([r["length"] for r in histogram], np.int64), np.asarray([r["n"] for r in histogram], np.int64), capacity)
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(common.SALTS))
    ranked = common.ranks_within(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], salt)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity, see plan_bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        span = int(p["first"].max(initial=0)) + 1
        shift = max(1, int(np.ceil(np.log2(span + 1))))
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            # the interval of a length that starts last at or before the rank
            starts = np.searchsorted(p["length"], length)
            at = np.searchsorted((p["length"] << shift) | p["first"], (length << shift) | np.minimum(rank, span), "right") - 1
            at = np.maximum(at, starts)
            over = rank - p["first"][at]
            sequence = p["bin"][at] + over // p["each"][at]
            offset = p["offset"][at] + (over % p["each"][at]) * length
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pack whole ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    Null or empty text: one piece of the id ``end``. Null doc_ids stay null. Repeated rows are
    packed once each. Long texts are cut into pieces of ``capacity`` ids; nothing is left out.
    Pieces of one length take places in the order of doc_id, piece, start and CRC within a
    slice by hash; only equal rows tie there, so reruns agree. Extra columns, whatever their
    names, are left out. Empty table: no rows.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    pieces = common.materialise(encoded_pieces(docs, tokenizer_path, capacity, end), "pieces")
    return place(pieces, capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the doc_ids in their order.

    A sequence is at most ``capacity`` ids, so no group grows with the corpus. Documents are
    encoded anew instead of being carried through the packer.
    """
    ids = encoded_pieces(docs.dropDuplicates(["doc_id"]), tokenizer_path, capacity, end, with_ids=True).select("doc_id", "piece", "ids")
    rows = placed.join(ids, ["doc_id", "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return rows.groupBy("sequence_id").agg(ordered.alias("o")).select("sequence_id", F.flatten(F.col("o.ids")).alias("ids"), F.col("o.doc_id").alias("doc_ids"))
