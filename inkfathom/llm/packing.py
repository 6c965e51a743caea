"""Hierarchical multi-length packing of documents into training sequences.

A document's ids are cut into whole long windows while they last; the rest is routed to the tier of the smallest context
size that holds it (256, 512, 1024, 2048 by default). Each tier is packed from the longest down: a window opens with the
tier's longest piece, its gap is filled with the longest shorter piece that fits, again and again, and where none fits a
piece is cut to size. So windows are full and no id is lost. What a task cannot fill at its end is cut into windows of
powers of two, which need no padding either (at most one of each size a task). Sequences of a tier are dealt into step
groups of equal tokens; the tiers' last incomplete groups are merged, longest first into the lightest.

One pass over the scan's partitions, no shuffle: a task holds `block_ids` ids and the open windows, whatever the length
of a document (a long text is encoded twice, for its number of ids first), and a lost task is done again with the same result.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

TIERS = (256, 512, 1024, 2048)
STEP_IDS = 65_536
END_ID = 1
COLUMNS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step_group bigint"
#: Fixed pattern: the pre-tokenizer of the byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts beyond this are encoded in parts, cut where a letter, one space and a letter meet: a sure token border.
PART_CHARS = 200_000
_BORDER = re.compile(r"[A-Za-z](?= [A-Za-z])")


def _checked(spec: dict) -> None:
    """Raises where a tokenizer file asks for anything that Encoder would not do as the tokenizers library does."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wrong = [k for k in ("normalizer", "post_processor", "truncation", "padding") if spec.get(k)]
    wrong += ["pre_tokenizer"] * (pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") is not False or pre.get("use_regex", True) is not True)
    wrong += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["model"] * (model["type"] != "BPE")
    wrong += [t["content"] for t in spec["added_tokens"] if not t["special"] or any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    by_rank = sorted(model["vocab"], key=model["vocab"].get)
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    added = {t["content"] for t in spec["added_tokens"]}
    if [t for t in by_rank if t not in added][256:] != made:  # tiktoken merges by identifier, the library by the merges' order
        wrong.append("merges")
    if wrong:
        raise ValueError(f"this tokenizer file needs what the encoder does not do: {', '.join(wrong)}")


class Encoder:
    """Ids of a byte-level BPE tokenizer file (tokenizers' JSON), special tokens in texts included, as that library gives
    them; encoded by tiktoken, which takes a quarter of the time and needs no offsets. Files that ask for more are refused."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _checked(spec)
        # fixed rule of byte-level files: printable bytes stand for themselves, the others for characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(shown)))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._encoding = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self._special = set(special)

    def parts(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        while at < len(text):
            cut = len(text)
            if cut - at > PART_CHARS and (m := _BORDER.search(text, at + PART_CHARS)):
                cut = m.end()
            yield np.array(self._encoding.encode(text[at:cut], allowed_special=self._special), dtype="<u4")
            at = cut


class Piece:
    __slots__ = ("doc", "ids", "start")

    def __init__(self, doc: tuple, start: int, ids: np.ndarray):
        self.doc, self.start, self.ids = doc, start, ids

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n]), Piece(self.doc, self.start + n, self.ids[n:])


class Pool:
    """Pieces by length; a bit set of the lengths present finds the longest one up to a bound at once."""

    def __init__(self):
        self.by_length: dict[int, list[Piece]] = defaultdict(list)
        self.lengths, self.ids = 0, 0

    def put(self, p: Piece) -> None:
        n = len(p.ids)
        self.by_length[n].append(p)
        self.lengths |= 1 << n
        self.ids += n

    def take(self, bound: int) -> Piece | None:
        n = (self.lengths & ((2 << bound) - 1)).bit_length() - 1
        if n <= 0:
            return None
        p = self.by_length[n].pop()
        if not self.by_length[n]:
            self.lengths &= ~(1 << n)
        self.ids -= n
        return p

    def fill(self, size: int) -> list[Piece]:
        """Pieces of `size` ids in all, or of all that are left."""
        window, gap = [], size
        while gap and self.ids:
            p = self.take(gap)
            if p is None:  # all are longer than the gap
                p = self.take(self.lengths.bit_length())
                p, rest = p.cut(gap)
                self.put(rest)
            window.append(p)
            gap -= len(p.ids)
        return window


class Packer:
    """Feed documents, then finish(); both yield lists of (sequence number, tier, step group, [pieces])."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_ids: int = STEP_IDS, block_ids: int = 1_000_000):
        self.tiers, self.step_ids, self.block_ids = sorted(tiers), step_ids, block_ids
        self.pool, self.ready, self.n_sequences, self.n_groups = Pool(), [], 0, 0
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def _sequence(self, tier: int, pieces: list[Piece]) -> None:
        group = self.open[tier]
        group.append((self.n_sequences, tier, pieces))
        self.n_sequences += 1
        if len(group) * tier >= self.step_ids:
            self._group(self.open.pop(tier))

    def _group(self, sequences: list[tuple]) -> None:
        self.ready += [(s, tier, self.n_groups, pieces) for s, tier, pieces in sequences]
        self.n_groups += 1

    def whole(self, p: Piece) -> None:
        self._sequence(self.tiers[-1], [p])

    def route(self, p: Piece) -> None:
        if len(p.ids):
            self.pool.put(p)

    def _pack(self, final: bool) -> None:
        for tier, below in zip(self.tiers[::-1], [*self.tiers[-2::-1], 0]):
            while self.pool.lengths >> (below + 1) and self.pool.ids >= tier:
                self._sequence(tier, self.pool.fill(tier))
        while final and self.pool.ids:
            size = 1 << (self.pool.ids.bit_length() - 1)
            self._sequence(min(size, self.tiers[-1]), self.pool.fill(min(size, self.tiers[-1])))

    def flush(self, final: bool = False) -> list[tuple]:
        if final or self.pool.ids >= self.block_ids:
            self._pack(final)
        if final:
            rest = sorted((x for g in self.open.values() for x in g), key=lambda x: (-x[1], x[0]))
            n = -(-sum(x[1] for x in rest) // self.step_ids)
            light, groups = [(0, i) for i in range(n)], [[] for _ in range(n)]
            for x in rest:
                ids, i = heapq.heappop(light)
                groups[i].append(x)
                heapq.heappush(light, (ids + x[1], i))
            self.open.clear()
            for g in groups:
                self._group(g)
        out, self.ready = self.ready, []
        return out


def _packed(tokenizer: str, tiers: tuple[int, ...], step_ids: int, end_id: int, with_ids: bool, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, size, base = None, Packer(tiers, step_ids), max(tiers), TaskContext.get().partitionId() << 40
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", *["ids"] * with_ids]
        types = [id_type, *[pa.int64()] * 8, *[pa.list_(pa.int32())] * with_ids]

        def rows(sequences: list[tuple]) -> Iterator[pa.RecordBatch]:
            out = []
            for s, tier, group, pieces in sequences:
                offset = 0
                for p in pieces:
                    crc = zlib.crc32(p.ids.tobytes())
                    out.append((p.doc[0], p.start, len(p.ids), crc, p.doc[1], base + s, offset, tier, base + group, *[p.ids.astype("i4")] * with_ids))
                    offset += len(p.ids)
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 20_000]), types)], names=names)

        for batch in batches:
            encoder = encoder or Encoder(tokenizer)
            for doc_id, text in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1))):
                held, total = np.empty(0, "<u4"), 0
                # a piece names its document's number of ids: a text of several parts is encoded twice, not held
                doc = (doc_id, sum(map(len, encoder.parts(text))) + 1) if len(text or "") > PART_CHARS else None
                for ids in encoder.parts(text or ""):
                    held, at = np.concatenate([held, ids]) if len(held) else ids, 0
                    while doc and len(held) - at > size:
                        packer.whole(Piece(doc, total, held[at : at + size].copy()))
                        total, at = total + size, at + size
                    held = held[at:]
                    if len(packer.ready) > 500:
                        yield from rows(packer.flush())
                held = np.append(held, np.uint32(end_id)).astype("<u4")
                doc = doc or (doc_id, total + len(held))
                while len(held) >= size:
                    packer.whole(Piece(doc, total, held[:size]))
                    total, held = total + size, held[size:]
                packer.route(Piece(doc, total, held))
                if packer.pool.ids >= packer.block_ids or len(packer.ready) > 500:
                    yield from rows(packer.flush())
        yield from rows(packer.flush(final=True))

    return run


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_ids: int = STEP_IDS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group (and ids).

    Null and empty texts are documents of the end id alone. A null identifier stays null; repeated rows are packed as
    often as they come. An empty table gives no rows. Other columns are not read. Context sizes must be powers of two.
    """
    bounded_batches(df.sparkSession)
    if not tiers or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("context sizes are powers of two")
    from pyspark.sql.pandas.types import to_arrow_type

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType
    schema = f"id {kind.simpleString()}, {COLUMNS}" + ", ids array<int>" * with_ids
    return docs.mapInArrow(_packed(tokenizer, tuple(tiers), step_ids, end_id, with_ids, to_arrow_type(kind)), schema).withColumnRenamed("id", id_col)
