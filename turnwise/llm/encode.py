"""Token ids of every text by a public byte-level BPE, built up a tree of halves.

Method: monoid tree reduction. A text is halved until its pieces have at most
``leaf_chars`` characters; the pieces are encoded, and neighbours are joined up
the tree. Where two pieces meet, a window is re-encoded that grows on both sides
until it ends in places where the result outside provably cannot change: between
a character that is no white space and a following space or newline, where every
pre-tokenization of this family splits whatever stands around it. Joining is
associative, so the tree may have any shape. Texts up to ``task_chars`` run
through the tree inside one task; longer ones are cut into stretches that are
encoded on many tasks. A stretch keeps its settled ids and two windows of text, up
to its first and from its last safe place; neighbours are joined by encoding the
windows between them, which grow where a stretch has no safe place.

Decoding goes up the same tree by concatenating bytes.

Defined cases: a null text has the ids of the empty text (none); strings that look
like special tokens are ordinary text; rows keep their id, also when it repeats
or is null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, name: str = NAME):
    """The tokenizer of a ``.tiktoken`` file, loaded once per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _safe(text: str, at: int) -> bool:
    """Whether every pre-tokenization splits before ``at``, whatever surrounds it."""
    return 0 < at < len(text) and text[at] in " \n" and not text[at - 1].isspace()


def join(left: str, left_ids: list[int], right: str, right_ids: list[int], encode, window: int = 16) -> list[int]:
    """The ids of ``left + right`` from the ids of both, by re-encoding around the seam.

    Each side's window starts at ``window`` characters and doubles until it ends
    at a safe place or at the end of the text. The ids outside stay: in a safe
    place the encoding of the whole is that of the two sides, one after another.
    """
    if not left or not right:
        return left_ids + right_ids
    a, w = len(left), window
    while a > 0:
        a = next((i for i in range(max(0, len(left) - w), len(left)) if _safe(left, i)), 0 if w >= len(left) else -1)
        if a >= 0:
            break
        a, w = len(left), 2 * w
    b, w = 0, window
    while True:
        b = next((i for i in range(min(w, len(right)) - 1, 0, -1) if _safe(right, i)), len(right) if w >= len(right) else -1)
        if b >= 0:
            break
        w *= 2
    kept_left = len(left_ids) - len(encode(left[a:])) if a else 0
    kept_right = len(encode(right[:b])) if b < len(right) else len(right_ids)
    return left_ids[:kept_left] + encode(left[a:] + right[:b]) + right_ids[kept_right:]


def tree_encode(text: str, encode, leaf_chars: int) -> list[int]:
    """Halve, encode, join: the same ids as ``encode(text)``."""
    if len(text) <= leaf_chars:
        return encode(text) if text else []
    mid = len(text) // 2
    left, right = text[:mid], text[mid:]
    return join(left, tree_encode(left, encode, leaf_chars), right, tree_encode(right, encode, leaf_chars), encode)


@dataclass
class Part:
    """A stretch of text between its growing windows: ``head`` and ``tail`` are text, ``ids`` what lies settled between.

    ``ids`` is None where no place of the stretch is safe: then all of it is
    ``head``. ``ids`` may be anything that ``+`` joins, such as arrays or numbers.
    """

    head: str
    ids: object
    tail: str


def part_of(text: str, encode) -> Part:
    """The part of one stretch: its windows reach to the first and from the last safe place."""
    first = next((i for i in range(1, len(text)) if _safe(text, i)), None)
    if first is None:
        return Part(text, None, "")
    last = next(i for i in range(len(text) - 1, 0, -1) if _safe(text, i))
    return Part(text[:first], encode(text[first:last]), text[last:])


def joined(a: Part, b: Part, encode) -> Part:
    """Two neighbours as one part: only the text between their settled ids is encoded, up to safe places."""
    if a.ids is None and b.ids is None:
        return _resettled(a.head, b.head, encode)
    if a.ids is None:
        return _grown(a.head, b, encode)
    if b.ids is None:
        m = _resettled(a.tail, b.head, encode)
        return Part(a.head, a.ids, m.head) if m.ids is None else Part(a.head, a.ids + encode(m.head) + m.ids, m.tail)
    return Part(a.head, a.ids + encode(a.tail + b.head) + b.ids, b.tail)


def _resettled(left: str, right: str, encode) -> Part:
    """Two texts without a safe place inside; one may lie where they meet."""
    if _safe(left + right[:1], len(left)):
        return Part(left, encode(""), right)
    return Part(left + right, None, "")


def _grown(text: str, b: Part, encode) -> Part:
    m = _resettled(text, b.head, encode)
    return Part(m.head, b.ids, b.tail) if m.ids is None else Part(m.head, m.ids + encode(m.tail) + b.ids, b.tail)


def tree_joined(parts: list[Part], encode) -> object:
    """All parts of one text joined pairwise, level by level; the ids of the whole."""
    while len(parts) > 1:
        pairs = [joined(a, b, encode) for a, b in zip(parts[::2], parts[1::2], strict=False)]
        parts = pairs + parts[len(pairs) * 2 :]
    p = parts[0]
    return encode(p.head) if p.ids is None else encode(p.head) + p.ids + encode(p.tail)


def _arrow(field) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _short(docs: DataFrame, count: bool, leaf_chars: int, folder: str, name: str) -> DataFrame:
    """``docs`` with ``ids`` (or ``tokens``) instead of ``text``: every text goes through the tree in its task."""
    kept = docs.drop("text")
    out = pa.int64() if count else pa.list_(pa.int32())
    schema = pa.schema([*[pa.field(f.name, _arrow(f)) for f in kept.schema], pa.field("tokens" if count else "ids", out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            # a few texts at a time: ids as Python numbers take much memory
            for at in range(0, batch.num_rows, 256):
                ids = [tree_encode(t.as_py() or "", encode, leaf_chars) for t in texts.slice(at, 256)]
                made = pa.array([len(i) for i in ids] if count else ids, out)
                columns = [c.slice(at, 256).cast(f.type) for c, f in zip(batch.columns[:-1], schema, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, made], schema=schema)

    return docs.select(*kept.columns, F.col("text").alias("__text")).mapInArrow(run, f"{_kinds(kept)}, " + ("tokens long" if count else "ids array<int>"))


def _long(docs: DataFrame, count: bool, leaf_chars: int, task_chars: int, folder: str, name: str) -> DataFrame:
    """The same for texts of any length: stretches are encoded on many tasks, then their windows are joined up the tree.

    Of a stretch only its ids (or their number) and its two windows of text travel
    on; the parts of one text meet where its result row is made.
    """
    kept = docs.drop("text")
    own = [pa.field(f.name, _arrow(f)) for f in kept.schema]
    # a number of its own for each row, as keys may repeat
    rows = docs.select(*kept.columns, F.monotonically_increasing_id().alias("__row"), F.col("text").alias("__text"))
    place = [*own, pa.field("__row", pa.int64()), pa.field("__part", pa.int64())]
    pieces = pa.schema([*place, pa.field("__text", pa.string())])
    out = pa.int64() if count else pa.list_(pa.int32())
    made = pa.schema([*place, pa.field("__head", pa.string()), pa.field("__ids", out), pa.field("__tail", pa.string())])
    result = pa.schema([*own, pa.field("tokens" if count else "ids", out)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, t = [c.slice(i, 1) for c in batch.columns[:-1]], batch.column(batch.num_columns - 1)[i].as_py()
                for k, at in enumerate(range(0, len(t), task_chars)):
                    yield _record([*row, pa.array([k]), pa.array([t[at : at + task_chars]])], pieces)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name).encode_ordinary
        for batch in batches:
            for i in range(batch.num_rows):
                p = part_of(batch.column(batch.num_columns - 1)[i].as_py(), lambda t: tree_encode(t, encode, leaf_chars))
                ids = None if p.ids is None else len(p.ids) if count else p.ids
                yield _record([*(c.slice(i, 1) for c in batch.columns[:-1]), pa.array([p.head]), pa.array([ids], out), pa.array([p.tail])], made)

    def top(table: pa.Table) -> pa.Table:
        encode = encoder(folder, name).encode_ordinary
        table = table.sort_by("__part")
        if count:
            ids, window = table["__ids"].to_pylist(), lambda t: len(tree_encode(t, encode, leaf_chars))
        else:
            ids, window = [_Chunks([x.values]) if x.is_valid else None for x in table["__ids"]], lambda t: _Chunks([pa.array(tree_encode(t, encode, leaf_chars), pa.int32())])
        whole = tree_joined([Part(*p) for p in zip(table["__head"].to_pylist(), ids, table["__tail"].to_pylist(), strict=True)], window)
        value = pa.array([whole], pa.int64()) if count else whole.as_list()
        return pa.Table.from_batches([_record([*(table[f.name].slice(0, 1).combine_chunks() for f in own), value], result)])

    kinds = f"{_kinds(kept)}, __row long, __part long"
    stretches = rows.mapInArrow(split, f"{kinds}, __text string").repartition("__row", "__part")
    parts = stretches.mapInArrow(leaves, f"{kinds}, __head string, __ids {'long' if count else 'array<int>'}, __tail string")
    return parts.groupBy("__row").applyInArrow(top, f"{_kinds(kept)}, " + ("tokens long" if count else "ids array<int>"))


def _record(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of ``schema``; a column in chunks becomes one."""
    whole = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(whole, schema, strict=True)], schema=schema)


class _Chunks:
    """Arrow arrays that ``+`` puts one after another without copying."""

    def __init__(self, arrays: list[pa.Array]):
        self.arrays = arrays

    def __add__(self, other: _Chunks) -> _Chunks:
        return _Chunks(self.arrays + other.arrays)

    def as_list(self) -> pa.Array:
        values = pa.concat_arrays(self.arrays)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _is_long(text: str, task_chars: int) -> Column:
    return F.coalesce(F.length(text) > task_chars, F.lit(False))


def _both(docs: DataFrame, count: bool, leaf_chars: int, task_chars: int, folder: str, name: str) -> DataFrame:
    long_text = _is_long("text", task_chars)
    return _short(docs.where(~long_text), count, leaf_chars, folder, name).unionByName(_long(docs.where(long_text), count, leaf_chars, task_chars, folder, name))


def token_ids(documents: DataFrame, leaf_chars: int = 1024, task_chars: int = 1 << 20, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """``doc_id, ids`` of every row of ``documents(doc_id, text)``."""
    return _both(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), False, leaf_chars, task_chars, folder, name)


def token_counts(documents: DataFrame, columns: list[str], leaf_chars: int = 1024, task_chars: int = 1 << 20, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """``columns`` and ``tokens``, the number of ids of ``text``; null texts have 0. The ids stay in the tasks."""
    return _both(documents.select(*columns, "text"), True, leaf_chars, task_chars, folder, name)


def tree_decode(ids: list[int], decode, leaf_ids: int = 1024) -> bytes:
    """Halve, decode, put the bytes together: characters may be cut between two ids, so text is made at the top only."""
    if len(ids) <= leaf_ids:
        return decode(ids)
    mid = len(ids) // 2
    return tree_decode(ids[:mid], decode, leaf_ids) + tree_decode(ids[mid:], decode, leaf_ids)


def decoded(encoded: DataFrame, task_ids: int = 1 << 19, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give the empty text.

    Lists beyond ``task_ids`` are cut into segments that many tasks decode, and
    whose bytes meet where the result row is made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(folder, name).decode_bytes
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [tree_decode(i.as_py() or [], decode).decode("utf-8", errors="replace") for i in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(folder, name).decode_bytes
        for batch in batches:
            raw = pa.array([tree_decode(i.as_py(), decode) for i in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], raw], names=["doc_id", "__row", "__part", "raw"])

    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("__part")
        text = b"".join(r.as_py() for r in table["raw"]).decode("utf-8", errors="replace")
        return pa.table({"doc_id": table["doc_id"].slice(0, 1), "text": pa.array([text], pa.string())})

    rows = encoded.select("doc_id", "ids")
    is_long = F.coalesce(F.size("ids") > task_ids, F.lit(False))
    short = rows.where(~is_long).mapInArrow(run, "doc_id long, text string")
    starts = F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / task_ids).cast("int"))
    cuts = F.transform(starts, lambda p: F.slice("ids", p * task_ids + 1, task_ids))
    numbered = rows.where(is_long).withColumn("__row", F.monotonically_increasing_id())
    segments = numbered.select("doc_id", "__row", F.posexplode(cuts).alias("__part", "ids"))
    parts = segments.repartition("__row", "__part").mapInArrow(leaves, "doc_id long, __row long, __part int, raw binary")
    return short.unionByName(parts.groupBy("__row").applyInArrow(top, "doc_id long, text string"))
