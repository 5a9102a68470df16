"""SentencePiece encoding and decoding, long documents in parallel chunks by a max-plus scan.

The model's pieces come from byte-pair merges. A sequence of pieces is the encoding of a text exactly if each two
neighbours encode to themselves, so an encoding is a path through a lattice: nodes are cuts with the piece that ends
there, an edge adds a piece with weight 0 if the pair fits and minus infinity if not, and the one path of weight 0
from the first cut to the last is the result. Paths compose in the max-plus semiring:

1. A document of more than `CHUNK` characters is split into chunks. A chunk's transfer matrix holds, for each state at
   its left boundary (the piece that crosses it) and each state at its right one, the weight of the best path.
2. The matrices of a document's chunks are combined associatively, in blocks and then along the blocks; that gives
   the state on the best path at every boundary.
3. Each chunk is traced back on its own between its two states.

No piece has a space marker after another character, so a boundary between two words has only one state, its matrix
is 1 x 1, and a chunk between two such boundaries is encoded at once. Splits fall there wherever a word ends in the
second half of a chunk; a matrix of more states arises in runs without a space only. A document of one chunk has
just its first and last cut. Between known cuts, the library encodes each distinct word once.

Decoding joins the pieces' bytes; chunks of it are independent.

Defined cases: null and empty texts have no ids; characters without a piece become byte pieces; U+2581 in a text is
read as a space, as the library does; rows repeating a doc_id are each encoded; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from postern.llm.batches import per_document
from postern.session import stage

CHUNK = 16_384
#: Chunks whose matrices are combined in one step.
BLOCK = 64
SPACE = "▁"

#: A state at a boundary: the crossing piece's begin and end, relative to the boundary. (0, 0): a cut before anything.
State = tuple[int, int]
START: State = (0, 0)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A byte-pair SentencePiece model: whole words by the library, paths between states by the lattice."""

    #: Words remembered.
    LIMIT = 250_000

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        plain = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        self.ids = {self.lib.id_to_piece(i): i for i in plain}
        self.score = {p: self.lib.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(self.lib.id_to_piece(i)[3:5], 16): i for i in range(n) if self.lib.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.raw = [b""] * n
        for piece, i in self.ids.items():
            self.raw[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        self.words: dict[str, bytes] = {}
        self.fits = lru_cache(1 << 18)(self._fits)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging its best pair, leftmost first, until none is left."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _fits(self, a: str, b: str) -> bool:
        return self.merged(a + b) == ([a, b] if a else [b])

    def piece_ids(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.byte[x] for x in piece.encode()]

    def starting(self, text: str, at: int) -> Iterator[str]:
        yield text[at]
        for end in range(at + 2, min(len(text), at + self.longest) + 1):
            if text[at:end] in self.ids:
                yield text[at:end]

    def states(self, text: str, at: int) -> list[State]:
        """States possible at a boundary inside a text: pieces that end at it or cross it."""
        found = []
        for begin in range(max(0, at - self.longest), at):
            for piece in self.starting(text, begin):
                if begin + len(piece) >= at:
                    found.append((begin - at, begin + len(piece) - at))
        return found

    def paths(self, text: str, left: int, right: int, entries: list[State], last: bool) -> dict[tuple[State, State], list[str] | None]:
        """Best paths of weight 0 between boundary states, with the pieces that end right of `left`'s state."""
        live: dict[int, dict[str, set[State]]] = {}
        for s in entries:
            begin, end = left + s[0], left + s[1]
            live.setdefault(end, {}).setdefault(text[begin:end], set()).add(s)
        out: dict[tuple[State, State], None] = {}
        for at in range(left, right + 1):
            for before, origins in live.pop(at, {}).items():
                if at >= right:
                    for s in origins:
                        out[s, (at - len(before) - right, at - right) if before else START] = None
                    continue
                for piece in self.starting(text, at):
                    if self.fits(before, piece):
                        end = at + len(piece)
                        if end < right:
                            live.setdefault(end, {}).setdefault(piece, set()).update(origins)
                        elif not last or end == right:
                            for s in origins:
                                out[s, (at - right, end - right)] = None
        for end, rest in live.items():  # an entry piece that reaches past the right boundary
            for before, origins in rest.items():
                for s in origins:
                    out[s, (end - len(before) - right, end - right)] = None
        return out

    def trace(self, text: str, left: int, right: int, entry: State, leave: State) -> list[str]:
        """Pieces after the entry state up to and with the leaving one."""
        if left + entry[1] >= right + leave[1]:
            return []
        back: dict[tuple[int, str], str | None] = {(left + entry[1], text[left + entry[0] : left + entry[1]]): None}
        at_piece: dict[int, list[str]] = {left + entry[1]: [text[left + entry[0] : left + entry[1]]]}
        stop = right + leave[1]
        for at in range(left + entry[1], stop):
            for before in at_piece.get(at, ()):
                for piece in self.starting(text, at):
                    end = at + len(piece)
                    if end <= stop and (end, piece) not in back and self.fits(before, piece):
                        back[end, piece] = before
                        at_piece.setdefault(end, []).append(piece)
        # After a certain cut everything fits, so the one path that reaches it is the best.
        key = (stop, text[right + leave[0] : stop]) if leave != START else next(k for k in back if k[0] == stop)
        out = []
        while back[key] is not None:
            out.append(key[1])
            key = key[0] - len(key[1]), back[key]
        return out[::-1]

    def encode_closed(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that begin and end at certain cuts, each beginning with the space marker."""
        if len(self.words) > self.LIMIT:
            self.words.clear()
        parts = [t[1:].replace(SPACE, " ").split(" ") if t else [] for t in texts]
        found = [list(map(self.words.get, units)) for units in parts]
        missed = [*{u for units, own in zip(parts, found) if None in own for u, x in zip(units, own) if x is None and u}]
        for unit, ids in zip(missed, self.lib.encode(missed, num_threads=1)):
            self.words[unit] = np.array(ids, np.int32).tobytes()
        out = []
        for text, units, own in zip(texts, parts, found):
            if text == SPACE:
                out.append(np.array(self.piece_ids(SPACE), np.int32))
            elif "" in units:
                out.append(np.array(self.lib.encode(text[1:].replace(SPACE, " ")), np.int32))
            else:
                out.append(np.frombuffer(b"".join([x if x is not None else self.words[u] for u, x in zip(units, own)]), np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def marked(text: str) -> str:
    """The text the lattice sees: spaces as markers, and one before it."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def cuts(text: str, chunk: int, splits: bool) -> list[tuple[int, bool]]:
    """Boundaries of a marked text and whether each is a certain cut: after a word in a chunk's second half if one ends there."""
    out, at = [(0, True)], 0
    while len(text) - at > chunk:
        low = at + max(1, chunk // 2)
        end = at + chunk
        while splits and end > low and not (text[end] == SPACE and text[end - 1] != SPACE):
            end -= 1
        sure = splits and text[end] == SPACE and text[end - 1] != SPACE
        at = end if sure else at + chunk
        out.append((at, sure))
    return [*out, (len(text), True)]


def product(a: dict, b: dict) -> dict:
    """Max-plus product of two sparse matrices that hold their 0 entries; the rest is minus infinity."""
    by: dict = {}
    for m, t in b:
        by.setdefault(m, []).append(t)
    return dict.fromkeys((s, t) for s, m in a for t in by.get(m, ()))


def resolve(matrices: list[dict], start: State, end: State, block: int = BLOCK) -> list[State]:
    """States at the boundaries between the matrices on the best path, from products of blocks, then inside each block."""
    if len(matrices) > block:
        groups = [matrices[i : i + block] for i in range(0, len(matrices), block)]
        whole = []
        for group in groups:
            m = group[0]
            for x in group[1:]:
                m = product(m, x)
            whole.append(m)
        edges = [start, *resolve(whole, start, end, block), end]
        out: list[State] = []
        for k, group in enumerate(groups):
            out += resolve(group, edges[k], edges[k + 1], block) + ([edges[k + 1]] if k + 1 < len(groups) else [])
        return out
    reach = [{start}]
    for m in matrices:
        reach.append({t for s, t in m if s in reach[-1]})
    out, now = [], end
    for k in range(len(matrices) - 1, 0, -1):
        now = next(s for s, t in matrices[k] if t == now and s in reach[k])
        out.append(now)
    return out[::-1]


_PAIR = ArrayType(IntegerType())


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id and ids."""
    path = model or default_model()
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"))
    long = F.coalesce(F.length("text") >= chunk, F.lit(False))  # with the marker in front: more than a chunk

    def whole(blobs: list[bytes | None]) -> list:
        made = pieces(path).encode_closed([marked((b or b"").decode()) for b in blobs])
        return [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in made])], pa.int32()), pa.array(np.concatenate(made) if made else np.zeros(0, np.int32)))]

    one = per_document(rows.where(~long), ["id"], "text", whole, [StructField("ids", ArrayType(IntegerType()))])
    return one.unionByName(_long(rows.where(long), path, chunk)).withColumnRenamed("id", doc_id)


def split(rows: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """Chunks of the documents with the context that states need: row, no, text, left, right (places in text), in_sure, out_sure, last."""
    out = StructType(
        [rows.schema["id"], rows.schema["row"], *[StructField(c, IntegerType()) for c in ("no", "left", "right")], StructField("text", StringType())]
        + [StructField(c, BooleanType()) for c in ("in_sure", "out_sure", "last")]
    )
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path)
        for batch in batches:
            for d, row, value in zip(*[c.to_pylist() for c in batch.columns]):
                s = marked(value)
                edges = cuts(s, chunk, m.splits)
                for no, ((a, sure_in), (b, sure_out)) in enumerate(zip(edges, edges[1:])):
                    lo, hi = max(0, a - m.longest), min(len(s), b + m.longest)
                    if sure_in:
                        lo = a
                    if sure_out:
                        hi = b
                    made = [d, row, no, a - lo, b - lo, s[lo:hi], sure_in, sure_out, no == len(edges) - 2]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(made, arrow)], schema=arrow)

    return rows.select("id", "row", "text").mapInArrow(run, out)


def _long(rows: DataFrame, path: str, chunk: int) -> DataFrame:
    """Documents of several chunks: transfer matrices, their combination, and each chunk's trace."""
    # Written once, so that row numbers are the same for every reader.
    parts = stage(split(rows.withColumn("row", F.monotonically_increasing_id()), path, chunk))
    unsure = parts.where(~(F.col("in_sure") & F.col("out_sure"))).repartition("row", "no")
    transfer = StructType([StructField("row", LongType()), StructField("no", IntegerType()), StructField("entries", ArrayType(_PAIR))])
    arrow = to_arrow_schema(transfer)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path)
        for batch in batches:
            for row, no, left, right, text, sure_in, sure_out, _ in zip(*[c.to_pylist() for c in batch.columns]):
                entries = [START] if sure_in else m.states(text, left)
                found = m.paths(text, left, right, entries, sure_out)
                if sure_out:
                    found = dict.fromkeys((s, START) for s, _ in found)
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([no], pa.int32()), pa.array([[[*s, *t] for s, t in found]], arrow.field(2).type)], schema=arrow)

    columns = ["row", "no", "left", "right", "text", "in_sure", "out_sure", "last"]
    found = unsure.select(*columns).mapInArrow(matrices, transfer)
    known = StructType([StructField("row", LongType()), StructField("no", IntegerType()), StructField("enter", _PAIR), StructField("leave", _PAIR)])

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("row", "no", "entries")]), key=lambda r: r[1])
        out, run = [], []
        for k, (row, no, entries) in enumerate(rows):
            run.append(dict.fromkeys(((s[0], s[1]), (s[2], s[3])) for s in entries))
            if k + 1 == len(rows) or rows[k + 1][1] != no + 1 or all(t == START for _, t in run[-1]):
                edges = [START, *resolve(run, START, START), START]
                out += [(row, no - len(run) + 1 + i, list(edges[i]), list(edges[i + 1])) for i in range(len(run))]
                run = []
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), to_arrow_schema(known))], schema=to_arrow_schema(known))

    states = found.groupBy("row").applyInArrow(combine, known)
    out = StructType([rows.schema["id"], StructField("row", LongType()), StructField("no", IntegerType()), StructField("ids", ArrayType(IntegerType()))])
    result = to_arrow_schema(out)

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path)
        for batch in batches:
            for d, row, no, left, right, text, enter, leave in zip(*[c.to_pylist() for c in batch.columns]):
                if enter is None:
                    ids = m.encode_closed([text])[0].tolist()
                else:
                    ids = [i for p in m.trace(text, left, right, tuple(enter), tuple(leave)) for i in m.piece_ids(p)]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([d, row, no, ids], result)], schema=result)

    chunks = parts.join(states, ["row", "no"], "left").select("id", "row", "no", "left", "right", "text", "enter", "leave").mapInArrow(traced, out)
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda c: c["ids"]))
    return chunks.groupBy("row").agg(F.first("id").alias("id"), joined.alias("ids")).select("id", "ids")


def decode(encoded: DataFrame, keep: list[str], ids: str = "ids", model: str | None = None) -> DataFrame:
    """The `keep` columns and the decoded text."""
    path = model or default_model()
    out = StructType([encoded.schema[c] for c in keep] + [StructField("text", StringType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path)
        for batch in batches:
            own = batch.column(len(keep))
            for lo in range(0, batch.num_rows, 256):
                part = own.slice(lo, 256)
                texts = [m.decode(x.values.to_numpy()) if x.is_valid else "" for x in part]
                yield pa.RecordBatch.from_arrays([*[batch.column(j).slice(lo, 256) for j in range(len(keep))], pa.array(texts, arrow.field(len(keep)).type)], schema=arrow)

    return encoded.select(*keep, ids).mapInArrow(run, out)


def digest(encoded: DataFrame, doc_id: str = "doc_id", model: str | None = None) -> DataFrame:
    """Per document: n_tokens, ids_crc32 (little-endian 32-bit ids), n_chars and text_crc32 of the decoded text."""
    path = model or default_model()
    out = StructType([encoded.schema[doc_id], *[StructField(c, LongType()) for c in ("n_tokens", "ids_crc32", "n_chars", "text_crc32")]])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path)
        for batch in batches:
            made = []
            for x in batch.column(1):
                ids = x.values.to_numpy()
                text = m.decode(ids)
                made.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(text), zlib.crc32(text.encode())))
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*made)]], schema=arrow)

    return encoded.select(doc_id, "ids").mapInArrow(run, out)
