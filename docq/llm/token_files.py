"""Token ids as flat files of unsigned integers, with 64-bit document offsets.

Texts are put in ascending order of their ids over partitions, and each
partition writes two files into a folder of a file system that all executors
share: `part-P.ids`, all token ids of its texts one after another (16-bit where
the vocabulary allows, else 32-bit, little-endian), and `part-P.off`, the
64-bit offsets at which its texts begin, and the end.  Partition bases, the
prefix sums of their counts, make offsets global; a reader maps the files (on a
file system that is not local it reads the range of a document) and never loads
them.  A task writes under a name of its own attempt and moves the
finished file, so a repeated or lost attempt leaves nothing half-written.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docq.llm.scratch import Scratch
from docq.llm.words import U, _powers, buffers, mix

#: Pieces in one generation of a worker's memory; there are two generations.
CACHE = 500_000
#: Characters encoded at once.
STEP = 2 << 20
#: Bytes of text in one part.
PART_BYTES = 64 << 20
OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
_BMP = 1 << 16
#: Endings that a byte-level tokenizer keeps with their apostrophe.
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
_encoders: dict = {}
# Long and odd texts are cut only here.
_CUT = re.compile(r"(?<=\S)(?= \S)")


class Known(dict):
    """Ids by piece, in two generations of at most `most` pieces each.

    A full generation becomes the old one, whose pieces come back when they are
    seen again; pieces that were not are forgotten with it.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def ids(self, piece: str) -> bytes | None:
        found = self.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is not None:
                self.keep(piece, found)
        return found

    def keep(self, piece: str, ids: bytes) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself where it
    is printable, else the next one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in seen)}
    return {b: chr(others.get(b, b)) for b in range(256)}


def character_kinds(pre_tokenizer) -> np.ndarray:
    """The kind of each character of the basic plane, as the tokenizer itself cuts
    it off its neighbours."""
    kinds = np.full(_BMP + 1, UNKNOWN, dtype=np.uint8)
    for c in [*range(0xD800), *range(0xE000, _BMP)]:
        cut = [span[0] for _, span in pre_tokenizer.pre_tokenize_str(f"a{chr(c)}1 {chr(c)}x")]
        # The cuts of "ac1 cx": where they fall tells what c goes with.
        kinds[c] = {(0, 2, 3): LETTER, (0, 1, 3, 5): NUMBER, (0, 1, 2, 3, 5): OTHER, (0, 1, 2, 3, 4, 5): SPACE}.get(tuple(cut), UNKNOWN)
    kinds[0x20] = SPACE
    return kinds


def piece_starts(codes: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of byte-level tokenizing begin, in texts that lie one after
    another in `codes` (code points) from `begins` on, none of them empty.

    A run of letters, of numbers or of other characters is a piece, with one
    space before it; an apostrophe that starts a piece takes an ending with it;
    of white space before a piece the last character stands alone.
    """
    n = len(codes)
    first = np.zeros(n + 1, dtype=bool)
    first[begins] = True
    first[n] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = codes[:-1] == 0x20
    blank_before &= ~first[:n]
    start = change & (space | ~blank_before)
    # The last white space of a run that does not end its text.
    start[:-1] |= space[:-1] & ~space[1:] & ~first[1:n]
    quote = np.flatnonzero(start & (codes == 0x27))
    for ending in _ENDINGS:
        at = quote[quote + len(ending) < n]
        for j, c in enumerate(ending, 1):
            at = at[(codes[at + j] == ord(c)) & ~first[at + j]]
        start[at + 1] = False
        after = at + 1 + len(ending)
        start[after[after < n]] |= ~(blank_before[after[after < n]] & (kind[after[after < n]] != SPACE))
    start[begins] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts, equal to the tokenizer's own.

    A byte-level tokenizer merges bytes inside pieces only.  Texts are cut into
    pieces as columns of code points; of each distinct piece the vocabulary's
    merges are asked once, then its ids are remembered.  Texts with added tokens
    or with characters beyond the basic plane, and all texts of other kinds of
    tokenizers, go to the tokenizer whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        spec = json.loads(self.tok.to_str())
        cut = spec["pre_tokenizer"] or {}
        self.by_pieces = spec["normalizer"] is None and spec["model"]["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.kinds = character_kinds(self.tok.pre_tokenizer) if self.by_pieces else np.zeros(0, np.uint8)
        # Surrogates, which no text holds, are the only characters of no kind.
        self.by_pieces = self.by_pieces and not (np.delete(self.kinds[:_BMP], np.s_[0xD800:0xE000]) == UNKNOWN).any()
        self.letters, self.known = _byte_letters(), Known(cache)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.known.ids(piece)
        if ids is None:
            merged = self.tok.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
            ids = self._bytes([t.id for t in merged])
            self.known.keep(piece, ids)
        return ids

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, none of them empty, all in the basic plane."""
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        begins = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        starts = piece_starts(codes, self.kinds[codes], begins[:-1])
        ends = np.append(starts[1:], len(codes))
        _, first, which = np.unique(hash_codes(codes, starts, ends), return_index=True, return_inverse=True)
        ids = [self._piece(whole[s:e]) for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        size = np.array([len(i) for i in ids]) // self.dtype.itemsize
        flat, head = np.frombuffer(b"".join(ids), dtype=self.dtype), np.cumsum(size) - size
        n = size[which]
        to = np.cumsum(n)
        out = flat[np.repeat(head[which] - (to - n), n) + np.arange(int(to[-1]))]
        ends_of = to[np.searchsorted(starts, begins[1:]) - 1]
        return [out[a:b].tobytes() for a, b in zip([0, *ends_of[:-1]], ends_of, strict=True)]

    def encode(self, texts: list[str], end: int | None) -> list[bytes]:
        """Little-endian ids of each text, with the end id after it."""
        tail = b"" if end is None else self._bytes([end])
        out: list[list[bytes]] = [[] for _ in texts]
        held, held_of, size = [], [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.by_pieces or max(t) > "\uffff" or any(a in t for a in self.added):
                parts = _CUT.split(t) if self.by_pieces else [t]
                out[i] = [self._bytes(e.ids) for e in self.tok.encode_batch(parts, add_special_tokens=False)]
                continue
            for part in cut_long(t):
                if held and size + len(part) > STEP:
                    for k, ids in zip(held_of, self._pieces(held), strict=True):
                        out[k].append(ids)
                    held, held_of, size = [], [], 0
                held.append(part)
                held_of.append(i)
                size += len(part)
        if held:
            for k, ids in zip(held_of, self._pieces(held), strict=True):
                out[k].append(ids)
        return [b"".join(x) + tail for x in out]


def cut_long(text: str):
    """The text in stretches of about STEP characters, cut where pieces part anyway."""
    at = 0
    while len(text) - at > STEP and (m := _CUT.search(text, at + STEP)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def hash_codes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of code points; the stretches tile the codes."""
    n = ends - starts
    rel = np.arange(len(codes)) - np.repeat(starts, n)
    vals = mix(codes.astype(np.uint64) + U(1)) * _powers(int(n.max()))[rel]
    return mix(np.add.reduceat(vals, starts) + n.astype(np.uint64) * U(0xD6E8FEB86659FD93))


def steps(texts: pa.Array, most: int = 2 * STEP):
    """(begin, end) of runs of texts of about `most` bytes; a longer text is a run of its own."""
    offsets, _ = buffers(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write(tokenizer_path: str, out: str, end: int | None):
    def run(batches):
        part, enc = TaskContext.get().partitionId(), _encoder(tokenizer_path)
        store, root = fs.FileSystem.from_uri(out)
        mine = f"{root}/_part-{part:06d}-{uuid.uuid4().hex}"
        at, offsets, rows = 0, [0], 0
        with store.open_output_stream(mine + ".ids") as ids, store.open_output_stream(mine + ".off") as off:
            for batch in batches:
                for a, b in steps(batch.column(1)):
                    piece = batch.slice(a, b - a)
                    got = enc.encode([t or "" for t in piece.column(1).to_pylist()], end)
                    ids.write(b"".join(got))
                    n = np.array([len(g) // enc.dtype.itemsize for g in got], dtype=np.int64)
                    offsets = at + np.concatenate(([0], np.cumsum(n)))
                    off.write(offsets[:-1].astype("<u8").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(rows, rows + len(n))), pa.array(np.full(len(n), enc.dtype.itemsize, np.int32))],
                        names=["doc_id", "part", "row", "width"],
                    )
                    at, rows = int(offsets[-1]), rows + len(n)
            off.write(np.array([at], dtype="<u8").tobytes())
        for kind in (".ids", ".off"):
            store.move(mine + kind, f"{root}/part-{part:06d}{kind}")

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", out: str | None = None, part_bytes: int = PART_BYTES) -> tuple[str, DataFrame]:
    """Write the files of all texts; returns their folder and a table of the
    documents: doc_id, part, row (place in the part), width (bytes of an id).

    Documents are in ascending order of doc_id over parts and rows (null first,
    repeated rows one after another, ties by text).  Null and empty texts have
    the end id alone, or nothing.  Other columns are not read.  An empty table
    gives an empty table.  A part holds about part_bytes bytes of text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    out = out or scratch.path("files")
    store, root = fs.FileSystem.from_uri(out)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    # Rows of one id, null included, spread by their texts, and equal rows by their place in the input.
    order = ["doc_id", F.crc32(F.col("text").cast("binary")), F.monotonically_increasing_id()]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order[:2])
    made = scratch.table(ordered.mapInArrow(_write(tokenizer_path, out, end_id), "doc_id long, part int, row long, width int"), "documents")
    for f in store.get_file_info(fs.FileSelector(root)):
        if f.base_name.startswith("_part-"):  # of an attempt that was lost
            store.delete_file(f.path)
    return out, made


def _read(out: str, bases: dict[int, int]):
    def run(batches):
        store, root = fs.FileSystem.from_uri(out)
        local = isinstance(store, fs.LocalFileSystem)
        held: dict[int, tuple] = {}

        def part_of(p, width):
            if p not in held:
                held.clear()
                if local:
                    ids = np.memmap(f"{root}/part-{p:06d}.ids", dtype=f"<u{width}", mode="r") if os.path.getsize(f"{root}/part-{p:06d}.ids") else np.zeros(0, f"<u{width}")
                    off = np.memmap(f"{root}/part-{p:06d}.off", dtype="<u8", mode="r")
                    held[p] = (lambda a, b: ids[a:b]), off
                else:
                    with store.open_input_file(f"{root}/part-{p:06d}.off") as f:
                        off = np.frombuffer(f.read(), dtype="<u8")
                    f = store.open_input_file(f"{root}/part-{p:06d}.ids")
                    held[p] = (lambda a, b: np.frombuffer(f.read_at((b - a) * width, a * width), dtype=f"<u{width}")), off
            return held[p]

        for batch in batches:
            start, count, crc = [], [], []
            for p, r, width in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                ids, off = part_of(p, width)
                a, b = int(off[r]), int(off[r + 1])
                start.append(bases[p] + a)
                count.append(b - a)
                crc.append(zlib.crc32(np.ascontiguousarray(ids(a, b)).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (start, count, crc))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def part_bases(spark: SparkSession, out: str, documents: DataFrame) -> dict[int, int]:
    """Ids before each part: prefix sums of the sizes of the files."""
    store, root = fs.FileSystem.from_uri(out)
    width = documents.select("width").limit(1).collect()
    files = sorted((f.base_name, f.size) for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-") and f.base_name.endswith(".ids"))
    bases, at = {}, 0
    for name, size in files:
        bases[int(name[5:11])] = at
        at += size // width[0].width if width else 0
    return bases


def read_tokens(out: str, documents: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers).

    documents: rows of write_tokens, any part of them, in any order; doc_id may
    be null or repeated.  An empty table gives an empty result.
    """
    bases = part_bases(documents.sparkSession, out, documents)
    return documents.mapInArrow(_read(out, bases), "doc_id long, start long, n_tokens long, ids_crc32 long")
