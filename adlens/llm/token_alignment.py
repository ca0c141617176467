"""Tokens of two tokenizers laid over each other, and how often their ids meet.

Both tokenizers cut the same bytes. The places where a token of each ends are the common
keys of two dictionaries from end to index, taken in order; between two such places lies a group, a
slice of both id lists. Every token of a group is linked to every token of the other side.

Links are counted over the whole corpus. Rows are packed in blocks: a block knows the
distinct id pairs of its documents and sends each only once, so what is shuffled grows
with blocks and vocabulary, not with tokens. The counts come back per block, never
as one table for all.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.session import cut_lineage

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: characters that are tokenized at once
TEXTS_AT_ONCE = 1 << 20
#: distinct links of documents that are packed together; one document is never cut
BLOCK_LINKS = 4_000_000
#: groups with more links are counted by distinct ids instead of link by link
LARGE_GROUP = 4096


def _byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


# fixed value: how byte-level vocabularies of this family cut a text before merging
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(path: str, special: set[int], bytes_of: list[bytes]):
    """An encoder by ranks where the file's merges are its ids in order, which is faster; else None."""
    with open(path, encoding="utf-8") as file:
        stated = json.load(file)
    vocabulary, merges = stated["model"]["vocab"], stated["model"]["merges"]
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
    before = stated["pre_tokenizer"] or {}
    plain = stated["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    ranks = {token: i for i, token in enumerate(bytes_of) if i not in special}
    if not plain or len(ranks) != 256 + len(merges) or any(vocabulary.get(m) != 256 + k for k, m in enumerate(joined)):
        return None
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _dictionary(lengths: np.ndarray, size: int) -> np.ndarray:
    """End of each token -> index behind it. An end is its own hash value: the dictionary is an array by end, 0 where none is."""
    index = np.zeros(size + 1, np.int64)
    index[np.cumsum(lengths)] = np.arange(1, len(lengths) + 1)
    return index


class Pair:
    """Two tokenizers with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        # a task has one core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            # a special entry holds characters outside the alphabet; texts never get its id
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.bytes_b = [
            bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))
        ]
        self.ranked = _ranked(path_a, set(self.a.get_added_tokens_decoder()), self.bytes_a)
        self.len_a, self.len_b = (np.array([len(t) for t in table]) for table in (self.bytes_a, self.bytes_b))
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        # ids as text behind each separator, for the written form of the groups
        signs = ((",", self.size_a), (";", self.size_a), (",", self.size_b), ("|", self.size_b))
        self.written = np.array([f"{sign}{i}" for sign, n in signs for i in range(n)], object)
        self.pieces = np.array(self.bytes_b, object)

    def _ids_a(self, text: str) -> list[int]:
        if self.ranked:
            return self.ranked.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of both sides and the index behind each group's last token, per text."""
        nothing = np.zeros(0, np.int64)
        for text, ids_b in zip(texts, self.b.encode(texts, num_threads=1)):
            whole = f" {text}".encode()
            b = np.array(ids_b, np.int64)
            if not text or b"".join(self.pieces[b].tolist()) != whole:
                yield nothing, nothing, nothing, nothing
                continue
            a = np.array(self._ids_a(f" {text}"), np.int64)
            if not self.ranked and b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole:
                yield nothing, nothing, nothing, nothing
                continue
            ends_a, ends_b = _dictionary(self.len_a[a], len(whole)), _dictionary(self.len_b[b], len(whole))
            common = np.flatnonzero((ends_a > 0) & (ends_b > 0))
            yield a, b, ends_a[common], ends_b[common]

    def links(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked id pairs, as ``a * size_b + b`` in ascending order, and how often each is linked."""
        n_a, n_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
        large = n_a * n_b > LARGE_GROUP
        # partners of each token of side a, and where they begin
        partners, begin = np.repeat(np.where(large, 0, n_b), n_a), np.repeat(cuts_b - n_b, n_a)
        ends = np.cumsum(partners)
        code = np.repeat(a * self.size_b, partners) + b[np.arange(ends[-1]) + np.repeat(begin - ends + partners, partners)]
        if not large.any():
            return np.unique(code, return_counts=True)
        codes, times = [code], [np.ones(len(code), np.int64)]
        for g in np.flatnonzero(large):
            one, of_one = np.unique(a[cuts_a[g] - n_a[g] : cuts_a[g]], return_counts=True)
            other, of_other = np.unique(b[cuts_b[g] - n_b[g] : cuts_b[g]], return_counts=True)
            codes.append((one[:, None] * self.size_b + other).ravel())
            times.append((of_one[:, None] * of_other).ravel())
        code, where = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, where, np.concatenate(times))
        return code, total

    def digest(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> str:
        """SHA-256 of the groups written as ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
        entry_a, entry_b = a.copy(), b + 2 * self.size_a
        entry_a[cuts_a - n_a] += self.size_a
        entry_b[cuts_b - n_b] += self.size_b
        entry = np.empty(len(a) + len(b), np.int64)
        entry[np.arange(len(a)) + np.repeat(cuts_b - n_b, n_a)] = entry_a
        entry[np.arange(len(b)) + np.repeat(cuts_a, n_b)] = entry_b
        return hashlib.sha256("".join(self.written[entry].tolist())[1:].encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _portions(texts: list) -> Iterator[tuple[int, list[str]]]:
    """Texts in portions of about TEXTS_AT_ONCE characters, with the first index; NULL as an empty text."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > TEXTS_AT_ONCE:
            yield first, held
            held, size, first = [], 0, i
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def align_tokens(
    docs: DataFrame, path_a: str = BYTE_LEVEL, path_b: str = PIECES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``a_ids``, ``b_ids``, ``a_cuts``, ``b_cuts``: both id lists and where groups end in them.

    Group g holds ``a_ids[a_cuts[g-1]:a_cuts[g]]`` and the same slice of ``b_ids``. The
    byte-level tokenizer reads a blank and the text, the other adds that blank itself;
    special tokens written in a text are plain text. Texts that are NULL or empty, or that
    one tokenizer does not give back byte for byte, have empty lists. One row per row, so
    repeated and NULL ids stay; other columns are not looked at; an empty table gives an empty one.
    The two files must lie under the same paths on every executor.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"

    def run(batches):
        pair = _pair(path_a, path_b)
        lists = pa.list_(pa.int32())
        for batch in batches:
            for first, texts in _portions(batch.column(1).to_pylist()):
                found = zip(*pair.align(texts))
                columns = [pa.array(c, type=lists) for c in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *columns],
                                                 ["id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


class _Block:
    """Documents whose distinct links are sent together."""

    def __init__(self, number: int):
        self.number, self.ids, self.figures, self.codes, self.times, self.size = number, [], [], [], [], 0

    def add(self, figures: tuple, code: np.ndarray, times: np.ndarray) -> None:
        self.figures.append(figures)
        self.codes.append(code)
        self.times.append(times)
        self.size += len(code)

    def rows(self, id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
        """A row per document, and one that lists the distinct pairs of all with their documents."""
        every = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int64)
        known, where, held = np.unique(every, return_inverse=True, return_counts=True)
        packed, at = [], 0
        for code, times in zip(self.codes, self.times):
            packed.append(_pack(where[at : at + len(code)], times))
            at += len(code)
        ids = pa.concat_arrays([*[i.cast(id_type) for i in self.ids], pa.nulls(1, id_type)])
        figures = list(zip(*self.figures, (0, 0, 0, 0, "")))
        return pa.RecordBatch.from_arrays([
            pa.array([self.number] * len(ids), pa.int64()), pa.array([False] * len(packed) + [True]), ids,
            *[pa.array(c, pa.int64()) for c in figures[:4]], pa.array(figures[4], pa.string()),
            pa.array([*packed, _pack(known, held)], pa.binary()),
        ], names)


def _pack(numbers: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers as steps, and a count for each, compressed."""
    both = np.concatenate([np.diff(numbers, prepend=0), times]).astype("<i8")
    return len(both).to_bytes(8, "little") + pa.compress(both.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    both = np.frombuffer(pa.decompress(data[8:], 8 * size, codec="zstd", asbytes=True), "<i8")
    return np.cumsum(both[: size // 2]), both[size // 2 :]


def _packed(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Aligned rows with figures and packed links, and the distinct links of each block."""
    names = ["block", "is_list", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
    schema = (f"block bigint, is_list boolean, id {rows.schema['id'].dataType.simpleString()}, n_a bigint, n_b bigint, "
              "n_groups bigint, n_links bigint, groups_sha256 string, links binary")

    def run(batches):
        pair = _pair(path_a, path_b)
        numbers = count(TaskContext.get().partitionId() << 32)
        block, id_type = _Block(next(numbers)), None
        for batch in batches:
            id_type = batch.column(0).type
            for first, texts in _portions(batch.column(1).to_pylist()):
                taken = first
                for k, found in enumerate(pair.align(texts), first):
                    a, b, cuts_a, cuts_b = found
                    code, times = pair.links(a, b, cuts_a, cuts_b) if len(a) else (a, b)
                    block.add((len(a), len(b), len(cuts_a), int(times.sum()), pair.digest(a, b, cuts_a, cuts_b) if len(a) else ""), code, times)
                    if block.size >= BLOCK_LINKS:
                        block.ids.append(batch.column(0).slice(taken, k + 1 - taken))
                        taken = k + 1
                        yield block.rows(id_type, names)
                        block = _Block(next(numbers))
                block.ids.append(batch.column(0).slice(taken, first + len(texts) - taken))
        if block.figures:
            yield block.rows(id_type, names)

    return rows.mapInArrow(run, schema)


def link_statistics(
    docs: DataFrame, path_a: str = BYTE_LEVEL, path_b: str = PIECES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Figures of the alignment per row of ``docs``, weighed by how many documents hold an id pair linked.

    ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (token pairs that share a group),
    ``n_best`` (links whose pair is held by as many documents as any pair of its first id),
    ``count_sum`` (documents that hold the pair, summed over links) and ``groups_sha256``
    (of ``a1,a2|b1;a3|b2,b3``). Rows without tokens (see ``align_tokens``) have zeros and an
    empty digest. Every row counts as a document, so repeated rows count twice; NULL ids
    stay; other columns are not looked at; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    stored = cut_lineage(_packed(rows, path_a, path_b))

    def listed(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code, held = _unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), number)), pa.array(code), pa.array(held)], ["block", "pair", "docs"])

    held = cut_lineage(stored.where("is_list").select("block", "links").mapInArrow(listed, "block bigint, pair bigint, docs bigint"))
    counts = held.groupBy("pair").agg(F.sum("docs").alias("docs"))
    size_b = _pair(path_a, path_b).size_b
    counts = counts.withColumn("a", F.expr(f"pair div {size_b}"))
    # a row per id of the first vocabulary, however large the corpus is
    most = F.broadcast(counts.groupBy("a").agg(F.max("docs").alias("most")))
    judged = counts.join(most, "a").select("pair", F.col("docs").alias("held"), (F.col("docs") == F.col("most")).alias("best"))
    back = held.select("block", "pair").join(judged, "pair")

    def weigh(key, documents: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs["pair"].to_numpy())
        held, best = pairs["held"].to_numpy()[order], pairs["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
        n_best, total = [], []
        for data in documents["links"]:
            at, times = _unpack(data.as_py())
            n_best.append(int(times @ best[at]))
            total.append(int(times @ held[at]))
        made = documents.drop_columns(["block", "links"])
        return made.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    documents = stored.where("not is_list").drop("is_list")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in documents.schema.fields if f.name not in ('block', 'links'))}, n_best bigint, count_sum bigint"
    weighed = documents.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(weigh, schema)
    return weighed.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
