"""Token ids as flat binary files with 64-bit document offsets.

Format of a folder: for part p, `p.ids` holds the ids of its documents one after another as little-endian unsigned
integers of the narrowest type that holds the vocabulary, and `p.off` holds little-endian unsigned 64-bit numbers:
the place in `p.ids` (counted in ids) where each document begins, and one more for the end. Parts and the documents
in them ascend by document id. A part's base, the ids in all parts before it, is a prefix sum over the parts' sizes
(one row a part), so any document is found in a memory-mapped file from base + offset without reading the rest.

Encoding: documents are dealt out by ranges of their id and sorted within a part. Text is cut where the tokenizer's
own pre-tokenizer cuts in any case: before a space or line break between two other characters; each task encodes
a unit once and keeps a bounded number of them. A text with two white-space characters in a row, or with a token
added to the vocabulary such as `<|endoftext|>`, is encoded whole; such tokens get their own ids, the library's default.

A task writes under a name of its own and renames at the end, so a task that runs twice makes the same complete files;
what a lost one leaves under its own name is removed when all parts are written. Each part is read back by a task of
its own. `session.clear_staged` removes the folder of a round trip that was given none. Defined cases: null and empty texts have the end id alone; a null id sorts first;
rows repeating an id are all written, ordered by text; an empty table makes a folder without documents.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from postern.llm.batches import slices
from postern.session import staged_folder

END_ID = 0
_PAIR = regex.compile(r"\s\s")
_SPACE = regex.compile(r"\s")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class UnitEncoder:
    """Ids of texts as bytes, a unit encoded once. Two generations of units are kept, so frequent ones stay."""

    #: Units of a generation, and new units encoded in one call.
    LIMIT, CALL = 600_000, 4_000
    MARKS = ".,;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        #: Units can't be told apart where a normalizer may make an added token, or one holds white space.
        self.uncut = bool(added) and (self.tokenizer.normalizer is not None or any(_SPACE.search(t) for t in added))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.line = self._ids("\n")
        self.mark = {m: self.pack(self._ids(m)) for m in self.MARKS}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def pack(self, ids: list[int] | np.ndarray) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def _joined(self, units: list[str], prefix: str) -> list[bytes]:
        """Units joined by line breaks, which are tokens of their own between other characters."""
        out: list[bytes] = []
        for at in range(0, len(units), self.CALL):
            part = units[at : at + self.CALL]
            ids = np.array(self._ids("\n".join(prefix + u for u in part)), self.dtype)
            cuts = np.flatnonzero(ids == self.line[0])
            if len(cuts) != len(part) - 1:
                raise ValueError("a line break is not a token of its own in this tokenizer")
            edges = [0, *(cuts + 1).tolist(), len(ids) + 1]
            out += [ids[a : b - 1].tobytes() for a, b in zip(edges, edges[1:])]
        return out

    def _learn(self, units: list[str]) -> None:
        """Remember the ids of units; one that is letters and a mark is put together from both, which are cut anyway."""
        body = {u: u[:-1] for u in units if u[-1] in self.mark and u[:-1].isalpha()}
        new = []
        for u in {body.get(u, u) for u in units}.difference(self.known):
            if (ids := self.older.get(u)) is not None:
                self.known[u] = ids
            else:
                new.append(u)
        plain, lines = [u for u in new if u[0] != "\n"], [u for u in new if u[0] == "\n"]
        self.known |= zip(plain, self._joined(plain, " "))
        lead = self.pack(self.line)
        self.known |= zip(lines, [lead + ids for ids in self._joined([u[1:] for u in lines], "")])
        for u, b in body.items():
            self.known[u] = self.known[b] + self.mark[u[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.LIMIT:
            self.known, self.older = {}, self.known
        plain, heads = [], []
        for text in texts:
            whole = not text or self.uncut or len(self.line) != 1 or text[0].isspace() or text[-1].isspace() or _PAIR.search(text) or (self.added and self.added.search(text))
            units = [] if whole else text.replace("\n", " \n").split(" ")
            heads.append(text if whole else units.pop(0))
            plain.append(units)
        get = self.known.get
        found = [list(map(get, units)) for units in plain]
        missed = [i for i, own in enumerate(found) if None in own]
        if missed:
            self._learn([*{u for i in missed for u, x in zip(plain[i], found[i]) if x is None}])
            for i in missed:
                found[i] = map(get, plain[i])
        first = self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)
        return [self.pack(head.ids) + b"".join(own) for head, own in zip(first, found)]


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def _local(folder: str) -> str:
    """Path of a mounted folder; memory maps need one."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"token files need a mounted shared folder, not {folder}")
    return url.path


def _flat(values: np.ndarray, path: str) -> None:
    with open(path, "wb") as f:
        values.tofile(f)


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files and return one row a part, ascending: part, file, docs, ids, base (ids in all parts before)."""
    path, root = tokenizer or default_tokenizer(), _local(folder)
    out = "first_id bigint, part int, file string, docs bigint, ids bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.makedirs(root, exist_ok=True)
        part, mine = TaskContext.get().partitionId(), f"{root}/.{uuid.uuid4().hex}"
        enc, at, sizes, names = encoder(path), 0, [0], []
        end = enc.pack([end_id])
        ids = f"{mine}.ids"
        with open(ids, "wb") as f:
            for batch in batches:
                names += batch.column(0).to_pylist()
                blobs = batch.column(1).cast(pa.binary()).to_pylist()
                for lo, hi in slices(blobs):
                    for own in enc.encode([(b or b"").decode() for b in blobs[lo:hi]]):
                        at += len(own) // enc.dtype.itemsize + 1
                        sizes.append(at)
                        f.write(own + end)
            f.flush()
            os.fsync(f.fileno())
        if not names:
            os.remove(ids)
            return
        _flat(np.array(sizes, "<u8"), f"{mine}.off")
        _flat(np.array([x if x is not None else 0 for x in names], "<i8"), f"{mine}.doc")
        _flat(np.packbits([x is None for x in names]), f"{mine}.nul")
        for kind in ("off", "doc", "nul", "ids"):
            os.replace(f"{mine}.{kind}", f"{root}/{part:06d}.{kind}")
        first = next((x for x in names if x is not None), None)
        yield pa.RecordBatch.from_pydict({"first_id": pa.array([first], pa.int64()), "part": pa.array([part], pa.int32()), "file": [f"{root}/{part:06d}"], "docs": [len(names)], "ids": [at]})

    dealt = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).repartitionByRange("d").sortWithinPartitions("d", "t")
    parts = dealt.mapInArrow(run, out)
    made = dealt.sparkSession.createDataFrame(parts.toArrow().to_pandas(), out)  # one row a part
    if os.path.isdir(root):
        for name in os.listdir(root):
            if name.startswith("."):
                os.remove(f"{root}/{name}")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return made.drop("first_id").withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(parts: DataFrame, dtype: str, doc_id: str = "doc_id") -> DataFrame:
    """Every document of the files, memory-mapped: id, start (base + offset), n_tokens, ids_crc32."""
    out = StructType([StructField(doc_id, LongType()), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, off = np.memmap(f"{row['file']}.ids", dtype, "r"), np.memmap(f"{row['file']}.off", "<u8", "r").astype(np.int64)
                names = np.memmap(f"{row['file']}.doc", "<i8", "r")
                null = np.unpackbits(np.memmap(f"{row['file']}.nul", np.uint8, "r"))[: len(names)].astype(bool)
                for lo in range(0, len(names), 10_000):
                    hi = min(len(names), lo + 10_000)
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(off[lo:hi], off[lo + 1 : hi + 1])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[lo:hi], mask=null[lo:hi]), pa.array(row["base"] + off[lo:hi]), pa.array(np.diff(off[lo : hi + 1])), pa.array(crc, pa.int64())], schema=arrow
                    )

    # A stated number of ranges is never merged: one read task a part, and none meets another's by a hash.
    return parts.repartitionByRange(max(1, parts.count()), "part").mapInArrow(run, out)


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the token files to a new folder of the shared one and read the documents back."""
    path = tokenizer or default_tokenizer()
    folder = folder or staged_folder(docs.sparkSession, "tokens")
    return read(write(docs, folder, doc_id, text, path), encoder(path).dtype.str, doc_id)
