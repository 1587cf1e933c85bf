"""Token ids by public tokenizers, and the separator scan over flat, unindexed token files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import file_size, open_file, own_dir, settle, text_batches

VOCABULARY = "word_bpe_49k.json"
CACHE = 64 << 20  # bytes of a generation of a worker's memory, two at most; what is forgotten is encoded again
LONG = 256  # characters; longer chunks (texts without blanks) are not remembered
ENTRY = 180  # bytes that a remembered chunk takes besides its characters and ids
BLOCK = 1 << 18  # ids of a block of a flat file
DTYPE = "<u2"  # of ids in files: the vocabulary's are below 65,536
SUPER = 1024  # blocks that are summed at the first level of the prefix scan

ODD_SPACE = re.compile("[\x1c-\x1f]")
NOT_LATIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f]")
ONE_PIECE = re.compile("[a-zß-öø-ÿ]+")
AT_ONCE = 1 << 23  # characters whose chunks are learned together
IN_A_ROW = 1 << 14  # words that are encoded as one text
BETWEEN = "\x1c"  # parts texts that are looked through together; none of these has it
END = 49407  # the vocabulary's end-of-text id, which ordinary text never has

_blank, _small, _stop = (np.isin(np.arange(256), list(x.encode("latin-1"))) for x in ("\t\n\v\f\r " + BETWEEN, "abcdefghijklmnopqrstuvwxyz", ",."))
_encoders: dict[tuple[str, bool], "Encoder"] = {}


def vocabulary(name: str = VOCABULARY) -> str:
    """The path of an installed public vocabulary, asked for where it is used: on the executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Ids by chunk in two generations: what is asked for again is kept anew, in the younger one."""

    def __init__(self, older: dict):
        super().__init__()
        self.older, self.size = older, 0

    def keep(self, chunks: list[str], ids: list[bytes]) -> None:
        self.update(zip(chunks, ids))
        self.size += _held(chunks, ids)


def _held(chunks: list[str], ids: list[bytes]) -> int:
    """Bytes that chunks and their ids take at most: a character has one, or up to four beyond ASCII."""
    wide = sum(map(len, filterfalse(str.isascii, chunks)))
    return ENTRY * len(chunks) + sum(map(len, chunks)) + 3 * wide + sum(map(len, ids))


def latin_chunks(texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Chunks of texts without separators U+001C to U+001F, in lower case, and how many of them end before each text and all.

    White space parts chunks, as does the beginning of a comma or full stop behind a small letter and before white space.
    All is told from the bytes at once.
    """
    raw = np.frombuffer(BETWEEN.join([*texts, ""]).lower().encode(), np.uint8)
    blank = _blank[raw]
    stops = np.flatnonzero(_stop[raw])
    stops = stops[blank[stops + 1]]  # a blank ends every text
    last, lead = raw[stops - 1], raw[stops - 2]
    small = _small[last] | (lead == 0xC3) & (last >= 0xA0) & (last <= 0xBF) & (last != 0xB7)
    begins = ~blank
    begins[1:] &= blank[:-1]
    begins[stops[small]] = True
    held = ~blank
    starts = np.append(np.flatnonzero(begins[held]), np.count_nonzero(held)).astype(np.int64)
    chunks = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(raw[held]))
    return chunks, np.append(0, np.searchsorted(np.flatnonzero(begins), np.flatnonzero(raw == ord(BETWEEN))))


class Encoder:
    """Ids of texts, equal to the tokenizer's own for the whole text.

    The tokenizer cuts at white space before all else and maps each piece by itself, so ids of white-space-separated
    chunks are remembered and joined. In texts of Latin letters, where lower case is the same to all, chunks are lower
    case and part with a comma or full stop at their end, so that fewer are to be known; texts with "<|" keep their case, as
    special tokens' strings are told by it. Texts with separators U+001C to U+001F, which are white space to Python only,
    are encoded whole. ``plain``: the strings of special tokens are ordinary text. ``limit`` bounds what is remembered, in
    bytes.
    """

    def __init__(self, name: str = VOCABULARY, plain: bool = False, limit: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.encode_special_tokens = plain
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.limit = limit
        self.known = _Known({})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.raw(texts)]

    def raw(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        latin, others, size = [], [], 0
        for i, text in enumerate(texts):
            if "<|" not in text and NOT_LATIN.search(text) is None:
                latin.append((i, text))
            elif ODD_SPACE.search(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                others.append((i, text.split()))
            size += len(text)
            if size >= AT_ONCE or i + 1 == len(texts):
                self._fill(out, latin, others)
                latin, others, size = [], [], 0
        return out

    def _fill(self, out: list[bytes], latin: list[tuple[int, str]], others: list[tuple[int, list[str]]]) -> None:
        """Ids of some texts' chunks, learned together where they are new."""
        if self.known.size >= self.limit:
            self.known.older = {}
            self.known = _Known(self.known)
        if others:
            long = self._learn(set().union(*[x for _, x in others]))
            for i, x in others:
                out[i] = b"".join([long[c] if c in long else self.known[c] for c in x] if long else map(self.known.__getitem__, x))
        if not latin:
            return
        # each distinct chunk is looked up once; its ids are then copied to where it stands
        chunks, bounds = latin_chunks([x for _, x in latin])
        chunks = chunks.dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        long = self._learn(distinct)
        found = [long[c] if c in long else self.known[c] for c in distinct] if long else list(map(self.known.__getitem__, distinct))
        taken = pa.array(found, pa.large_binary()).take(chunks.indices)
        _, places, flat = taken.buffers()
        if flat is None:  # no text has a chunk
            return
        ends = np.frombuffer(places, np.int64)[: len(taken) + 1]
        cuts, flat = ends[bounds], memoryview(flat)
        for (i, _), a, z in zip(latin, cuts[:-1].tolist(), cuts[1:].tolist()):
            out[i] = flat[a:z].tobytes()

    def each(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of a column of texts, null ones empty, a bounded number of characters at a time."""
        held, size = [], 0
        for t in texts:
            text = t.as_py() if t.is_valid else ""
            held.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield from self.raw(held)
                held, size = [], 0
        yield from self.raw(held)

    def _learn(self, asked) -> dict[str, bytes]:
        """New words of one piece are encoded in rows and parted behind the ids that end a word; others one by one.

        Ids of chunks too long to be remembered are returned.
        """
        known, older, long = self.known, self.known.older, {}

        def keep(chunks: list[str], ids: list[bytes]) -> None:
            if max(map(len, chunks)) > LONG:
                long.update((c, x) for c, x in zip(chunks, ids) if len(c) > LONG)
                ids = [x for c, x in zip(chunks, ids) if len(c) <= LONG]
                chunks = [c for c in chunks if len(c) <= LONG]
            known.keep(chunks, ids)

        unknown = [c for c in asked if c not in known]
        again = [c for c in unknown if c in older]
        known.keep(again, [older[c] for c in again])
        new = [c for c in unknown if c not in known] if again else unknown
        words = [c for c in new if ONE_PIECE.fullmatch(c)]
        for a in range(0, len(words), IN_A_ROW):
            part = words[a : a + IN_A_ROW]
            row = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.array(row.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            assert len(stops) == len(part)
            raw = ids.tobytes()
            keep(part, list(map(raw.__getitem__, map(slice, [0, *stops[:-1].tolist()], stops.tolist()))))
        rest = [c for c in new if not ONE_PIECE.fullmatch(c)]
        for a in range(0, len(rest), 4096):
            part = rest[a : a + 4096]
            keep(part, [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)])
        return long


def encoder(name: str = VOCABULARY, plain: bool = False) -> Encoder:
    """One a Python worker and vocabulary: reused workers keep what they know."""
    if (name, plain) not in _encoders:
        _encoders[name, plain] = Encoder(name, plain)
    return _encoders[name, plain]


def write_token_files(
    df: DataFrame, folder: str, doc: str = "doc_id", text: str = "text", end: int = END, name: str = VOCABULARY, dtype: str = DTYPE
) -> DataFrame:
    """Documents as flat token files below ``folder``, and the writer's list ``file, path, ordinal, doc``, lazily.

    A file is a partition's documents in order, each one's ids followed by ``end``, as numbers of ``dtype`` and nothing
    else. Files of tasks that were lost or tried again are in no list. Ids equal to ``end`` inside a text would end a
    document: such texts raise an error. Null texts are empty: a separator alone. Read the list once (settle it): every
    reading writes files anew.
    """
    text_batches(df.sparkSession)
    slim = df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    kind = slim.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, enc, out = TaskContext.get().partitionId(), 0, encoder(name, True), None
        path = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.bin"
        tail = np.array([end], dtype).tobytes()
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                out = out or open_file(path, "w")
                for raw in enc.each(b.column("text")):
                    ids = np.frombuffer(raw, "<u4")
                    if (ids == end).any():
                        raise ValueError(f"the end-of-document id {end} occurs inside a text")
                    out.write(ids.astype(dtype).tobytes() + tail)
                k = b.num_rows
                made = [pa.array(np.full(k, part, np.int32)), pa.array([path] * k, pa.string()), pa.array(np.arange(n, n + k)), b.column("doc")]
                n += k
                yield pa.RecordBatch.from_arrays(made, ["file", "path", "ordinal", "doc"])
        finally:
            if out:
                out.close()

    return slim.mapInArrow(run, f"file int, path string, ordinal bigint, doc {kind}")


def scan_token_files(files: DataFrame, end: int = END, dtype: str = DTYPE, block: int = BLOCK) -> DataFrame:
    """``file, block, n_ends, head, inner, tail`` (see ``scan_separators``) of flat token files, ``files(file, path)``.

    Files are cut into byte ranges of ``block`` ids that know nothing of documents; each range is read and searched where
    it is dealt to, so a single large file is read by all executors. Bytes that are no whole id raise an error; an empty
    file has no block.
    """
    width = np.dtype(dtype).itemsize

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [file_size(p) for p in b.column("path").to_pylist()]
            if any(n % width for n in sizes):
                raise ValueError(f"a token file of {dtype} ids has a number of bytes that {width} doesn't divide")
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("path"), pa.array(sizes, pa.int64())], ["file", "path", "size"])

    kind = files.schema["file"].dataType.simpleString()
    sized = files.select("file", "path").mapInArrow(measure, f"file {kind}, path string, size bigint").where("size > 0")
    ranges = sized.select("file", "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / (block * width)) - 1)).alias("block"))
    tasks = max(1, files.sparkSession.sparkContext.defaultParallelism)
    # blocks in a row go to one task, which reads on where it is
    ranges = ranges.repartitionByRange(4 * tasks, "file", "block").sortWithinPartitions("file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        try:
            for b in batches:
                rows = []
                for p, k in zip(b.column("path").to_pylist(), b.column("block").to_pylist()):
                    if p != path:
                        if source:
                            source.close()
                        path, source = p, open_file(p, "r")
                    source.seek(k * block * width)
                    rows.append(_separators(source.read(block * width), end, dtype))
                yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), *_scan_columns(rows)], ["file", "block", *SCAN])
        finally:
            if source:
                source.close()

    return ranges.select("file", "path", "block").mapInArrow(run, f"file {kind}, block bigint, {SCAN_DDL}")


SCAN = ["n_ends", "head", "inner", "tail"]
SCAN_DDL = "n_ends bigint, head bigint, inner array<bigint>, tail bigint"


def _separators(raw: bytes, end: int, dtype: str) -> tuple[int, int, np.ndarray, int]:
    ids = np.frombuffer(raw, dtype)
    at = np.flatnonzero(ids == end)
    if len(at):
        return len(at), int(at[0]), np.diff(at) - 1, len(ids) - 1 - int(at[-1])
    return 0, len(ids), at[:0], 0


def _scan_columns(rows: list[tuple]) -> list[pa.Array]:
    n, head, inner, tail = zip(*rows) if rows else [()] * 4
    return [pa.array(list(n), pa.int64()), pa.array(list(head), pa.int64()), pa.array([x.astype(np.int64) for x in inner], pa.list_(pa.int64())), pa.array(list(tail), pa.int64())]


def scan_separators(blocks: DataFrame, end: int = END, dtype: str = "<u4", keep: list[str] | None = None) -> DataFrame:
    """``keep, file, block, n_ends, head, inner, tail`` of blocks ``(file, block, ids)`` of flat token files.

    ``head`` counts the ids up to the block's first separator (all of them if it has none), ``inner`` holds the counts
    between separators, ``tail`` counts the ids after the last. Separators count for no document. An empty or null block
    has zeros.
    """
    keep = [] if keep is None else keep
    slim = blocks.select(*keep, F.col("file"), F.col("block"), F.col("ids"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_separators(raw.as_py() if raw.is_valid else b"", end, dtype) for raw in b.column("ids")]
            others = [n for n in b.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in others] + _scan_columns(rows), [*others, *SCAN])

    return slim.mapInArrow(run, f"{fields}, {SCAN_DDL}")


def stitch(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ``first`` (documents that end before the block) and ``carry`` (ids that its first one has there).

    A prefix scan in two levels: within runs of 1,024 blocks, then over the runs' sums, so that no window holds more
    than a file's runs. ``open_n`` counts ids since the last separator. Blocks of a file are numbered from 0 without
    gaps.
    """
    runs = scanned.withColumn("run", F.floor(F.col("block") / SUPER))
    inside = "partition by file, run order by block rows between unbounded preceding and 1 preceding"
    # of the blocks before in the run: separators; ids after the last separator, or all ids if there is none
    runs = runs.selectExpr(
        "*",
        f"coalesce(sum(n_ends) over ({inside}), 0L) as ends_in",
        f"max(case when n_ends > 0 then block end) over ({inside}) as last_in",
        f"coalesce(sum(head + tail) over ({inside}), 0L) as open_sum",
    )
    # ids up to and with each block that belong to an open document: those of blocks without a separator, and tails
    at_last = "max_by(struct(block, tail, open_sum + head + tail as upto), case when n_ends > 0 then block end)"
    sums = runs.groupBy("file", "run").agg(
        F.sum("n_ends").alias("n"), F.expr(at_last).alias("at"), F.sum(F.col("head") + F.col("tail")).alias("all")
    )
    sums = sums.selectExpr("file", "run", "n", "if(n > 0, at.tail + all - at.upto, all) as open", "n > 0 as cuts")
    over = "partition by file order by run rows between unbounded preceding and 1 preceding"
    sums = sums.selectExpr(
        "*", f"coalesce(sum(n) over ({over}), 0L) as ends_before", f"max(case when cuts then run end) over ({over}) as last_cut", f"coalesce(sum(open) over ({over}), 0L) as open_before"
    )
    # open ids before a run: what the runs since the last one with a separator left open, that one's included
    cut = sums.where("cuts").select("file", F.col("run").alias("last_cut"), (F.col("open_before")).alias("cut_before"))
    sums = sums.join(cut, ["file", "last_cut"], "left").selectExpr("file", "run", "ends_before", "open_before - coalesce(cut_before, 0L) as carry_run")
    last = runs.where("n_ends > 0").selectExpr("file", "run", "block as last_in", "open_sum + head as last_sum")
    return (
        runs.join(sums, ["file", "run"])
        .join(last, ["file", "run", "last_in"], "left")
        .withColumn("first", F.col("ends_before") + F.col("ends_in"))
        .withColumn("carry", F.when(F.col("last_in").isNull(), F.col("carry_run") + F.col("open_sum")).otherwise(F.col("open_sum") - F.col("last_sum")))
        .drop("ends_in", "last_in", "open_sum", "ends_before", "carry_run", "last_sum", "run")
    )


def document_counts(stitched: DataFrame) -> DataFrame:
    """``file, ordinal, n_tokens`` of each document that ends in a file; ids after the last separator are none's."""
    ends = stitched.where("n_ends > 0")
    lengths = F.concat(F.array(F.col("carry") + F.col("head")), "inner")
    return ends.select("file", "first", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens")


def token_counts(df: DataFrame, doc: str = "doc_id", text: str = "text", end: int = END, name: str = VOCABULARY) -> DataFrame:
    """``doc, file, ordinal, n_tokens`` of every document, counted in flat token files by the separator scan.

    Documents are written as flat token files to the shared folder, the files are read back by byte ranges, and counts are
    matched with the writer's list by their ordinal in the file. Null and empty texts count 0; repeated rows are rows, and
    equal ordinals don't occur; an empty table has an empty result; columns besides ``doc`` and ``text`` are not looked at.
    """
    written = settle(write_token_files(df, own_dir(df.sparkSession), doc, text, end, name))
    counts = document_counts(stitch(settle(scan_token_files(written.select("file", "path").distinct(), end))))
    return written.join(counts, ["file", "ordinal"]).select(F.col("doc").alias(doc), "file", "ordinal", "n_tokens")
