"""Cross-tokenizer alignment: union-find over the bipartite graph of overlapping tokens, then distributed pair counting.

A document is encoded by a byte-level vocabulary (A) and by a sentencepiece model (B). A token of A and one of B are linked if
their byte ranges overlap. The connected components of these links are the minimal groups of tokens that cover the same
bytes; union-find finds them for all documents of a chunk at once: roots are hooked to the smaller root and paths are
halved in numpy arrays until no link joins two roots.

How many documents hold a pair of ids linked is counted over the corpus in two steps: a chunk counts its documents for each of
its distinct pairs, and Spark sums these counts. The sums go back to the chunks the same way (a chunk asks once for a
pair, however often its texts hold it), and each document adds up what its links have. No list of links is moved: a document
keeps its distinct pairs as numbers in the chunk's list and how often it has each.

Defined results: a null or empty text, and one whose tokens of either kind do not spell a space and the text, has no tokens
(zeros and an empty groups text); special strings are ordinary text; repeated rows are documents each; a null key is kept; an
empty table gives an empty result; other columns are left behind. A text is encoded whole, by one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pulsegrid.llm.common import BATCH_ROWS, materialize
from pulsegrid.llm.token_counts import SPACE, merge_table, pretokens

#: Characters of text that make a chunk; a longer text is one by itself.
CHUNK = 1_000_000
#: Pre-tokens of the piece model whose ids a worker keeps, and the longest of them.
CACHE, KEPT = 400_000, 64


@dataclass(frozen=True)
class Vocabularies:
    """The files of both: ranks and pattern of the byte-level one, the model of pieces."""

    ranks: str
    pattern: str
    pieces: str


class _Encoders:
    """Both encoders with the bytes of their ids."""

    def __init__(self, files: Vocabularies):
        import tiktoken

        with open(files.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
        self.len_a = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.len_a[i] = len(token)
        self.table = merge_table(files.pieces)
        m = self.b = self.table.model
        self.bytes_b = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(m.id_to_piece, range(m.get_piece_size())))]
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.kept: dict[str, list[int] | None] = {}
        # decimal ids followed by nothing, a comma, a bar or a semicolon
        top = max(len(self.len_a), len(self.len_b))
        self.decimal = np.array([f"{i}{s}" for i in range(top) for s in ("", ",", "|", ";")], object)

    def ids_a(self, text: str) -> np.ndarray:
        return self.a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)

    def _encode_words(self, words: list[str]) -> dict[str, list[int] | None]:
        """The ids of pre-tokens, or None for those that cannot be encoded by themselves."""
        alone = [w.replace(SPACE, " ") for w in words]
        pairs = zip(words, self.b.normalize(alone), self.b.encode(alone, num_threads=1), strict=True) if words else ()
        return {w: ids if normal == SPACE + w else None for w, normal, ids in pairs}

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        """As the library encodes each text; pre-tokens that no piece reaches across are encoded once."""
        if not self.table.splits:
            return self.b.encode(texts, num_threads=1)
        words = [pretokens(x, True) if x else [] for x in (self.b.normalize(texts) if texts else [])]
        if len(self.kept) > CACHE:
            self.kept.clear()
        new = self._encode_words(list(set(chain.from_iterable(words)).difference(self.kept)))
        self.kept.update(new)
        out = []
        for text, ws in zip(texts, words, strict=True):
            parts = list(map(self.kept.__getitem__, ws))
            out.append(self.b.encode(text) if None in parts else list(chain.from_iterable(parts)))
        for w in new:
            if len(w) > KEPT:
                del self.kept[w]
        return out


@lru_cache(maxsize=2)
def _loaded(files: Vocabularies) -> _Encoders:
    return _Encoders(files)


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each of n nodes' component, for the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above
    return root


@dataclass
class Aligned:
    """A chunk's documents, one after the other: tokens, groups and links."""

    n_a: np.ndarray  # of each document
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    link_a: np.ndarray  # the ids of each link
    link_b: np.ndarray


def align_texts(texts: list[str | None], files: Vocabularies) -> Aligned:
    e = _loaded(files)
    n = len(texts)
    sound, ids_a, ids_b = [], [], []
    some = [i for i, t in enumerate(texts) if t]
    for i, b in zip(some, e.ids_b([texts[i] for i in some]), strict=True):
        raw = (" " + texts[i]).encode()
        if b"".join(map(e.bytes_b.__getitem__, b)) != raw:
            continue
        a = e.ids_a(texts[i])
        if int(e.len_a[a].sum()) == len(raw):  # byte-level tokens spell what they encode
            sound.append(i)
            ids_a.append(a)
            ids_b.append(np.array(b, np.int64))
    at = np.array(sound, np.int64)

    def per_document(counts) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[at] = counts
        return out

    n_a, n_b = (per_document([len(x) for x in ids]) for ids in (ids_a, ids_b))
    if not sound:
        none = np.zeros(0, np.int64)
        return Aligned(n_a, n_b, n_a, n_a, [""] * n, none, none)
    a, b = np.concatenate(ids_a), np.concatenate(ids_b)
    # both kinds spell the same bytes, so documents end at the same places of both
    ends_a, ends_b = np.cumsum(e.len_a[a]), np.cumsum(e.len_b[b])
    mark = np.zeros(int(ends_a[-1]) + 1, np.uint8)
    mark[ends_a] = 1
    mark[ends_b] |= 2
    cuts = np.flatnonzero(mark)
    of_a, of_b = (mark[cuts] & 1).astype(np.int64), (mark[cuts] >> 1).astype(np.int64)
    left, right = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b  # the tokens over the bytes before each cut: one link
    root = union_find(left, len(a) + right, len(a) + len(b))
    first = root[: len(a)] == np.arange(len(a))
    number = np.cumsum(first) - 1
    group_a, group_b = number[root[: len(a)]], number[root[len(a) :]]
    count_a, count_b = np.bincount(group_a), np.bincount(group_b)
    start = np.cumsum(count_a + count_b) - count_a - count_b
    # places of the tokens in the groups' text, and what follows each
    place_a = start[group_a] + np.arange(len(a)) - (np.cumsum(count_a) - count_a)[group_a]
    place_b = start[group_b] + count_a[group_b] + np.arange(len(b)) - (np.cumsum(count_b) - count_b)[group_b]
    code = np.empty(len(a) + len(b), np.int64)
    code[place_a], code[place_b] = a * 4 + 1, b * 4 + 1
    code[start + count_a - 1] += 1
    code[start + count_a + count_b - 1] += 2
    parts = e.decimal[code]
    doc_ends = ends_a[np.cumsum([len(x) for x in ids_a]) - 1]
    links = np.diff(np.searchsorted(cuts, doc_ends, "right"), prepend=0)
    tokens = np.cumsum(n_a[at] + n_b[at]).tolist()
    groups = [""] * n
    for i, s, t in zip(sound, [0, *tokens], tokens, strict=False):
        groups[i] = "".join(parts[s:t].tolist())[:-1]
    last_a = np.cumsum(n_a[at])
    n_groups = np.diff(np.cumsum(first)[last_a - 1], prepend=0)
    return Aligned(n_a, n_b, per_document(n_groups), per_document(links), groups, a[left], b[right])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """Keys and texts of about ``CHUNK`` characters."""
    keys, texts, size = [], [], 0
    parts = (b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))
    for part in parts:
        for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if size and size + len(text or "") > CHUNK:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(key)
            texts.append(text)
            size += len(text or "") + 16
    if keys:
        yield keys, texts


def _pairs(x: Aligned, width: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """The chunk's distinct pairs (a * width + b, the most frequent first), in how many documents each is, and by document
    the numbers of its pairs, as differences, and how often it has them."""
    number, pairs = pd.factorize(x.link_a * width + x.link_b)
    order = np.argsort(-np.bincount(number, minlength=len(pairs)), kind="stable")
    rank = np.empty(len(pairs), np.int64)
    rank[order] = np.arange(len(pairs))
    owner = np.repeat(np.arange(len(x.n_links)), x.n_links)
    held, times = np.unique(owner * max(1, len(pairs)) + rank[number], return_counts=True)
    doc, pair = np.divmod(held, max(1, len(pairs)))
    docs = np.bincount(pair, minlength=len(pairs))
    ends = np.searchsorted(doc, np.arange(len(x.n_links)), "right").tolist()
    numbers, often = [], []
    for s, t in zip([0, *ends], ends, strict=False):
        numbers.append(np.diff(pair[s:t], prepend=0).astype("<u4").tobytes())
        often.append(times[s:t].astype("<u4").tobytes())
    return np.asarray(pairs, np.int64)[order], docs, numbers, often


def _spread(data: list[bytes]) -> list[bytes]:
    """Little-endian 32-bit numbers with their bytes regrouped: all first bytes, all second bytes, and so on; zeros then pack well."""
    return [np.frombuffer(x, np.uint8).reshape(-1, 4).T.tobytes() for x in data]


def _gathered(data: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(data, np.uint8).reshape(4, -1).T.tobytes(), "<u4").astype(np.int64)


def _encoded(docs: DataFrame, files: Vocabularies, key: str, text: str, with_groups: bool) -> DataFrame:
    """Written: a row a document, and a row a chunk (with ``pairs``) that lists its pairs and their documents."""
    kind = docs.schema[key].dataType.simpleString()
    key_type = to_arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        width = None
        for keys, texts in _chunks(batches):
            width = width or len(_loaded(files).len_b)
            x = align_texts(texts, files)
            pairs, n_docs, numbers, often = _pairs(x, width)
            n = len(keys)
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array(np.full(n + 1, chunk), pa.int64()), "_key": pa.array([*keys, None], key_type),
                    **{c: pa.array([*getattr(x, c).tolist(), None], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
                    "sha": pa.array([*[sha256(g.encode()).hexdigest() if g else "" for g in x.groups], None], pa.string()),
                    "groups": pa.array([*(x.groups if with_groups else [None] * n), None], pa.string()),
                    "numbers": pa.array([*_spread(numbers), None], pa.binary()), "often": pa.array([*_spread(often), None], pa.binary()),
                    "pairs": pa.array([*[None] * n, pairs.tolist()], pa.list_(pa.int64())), "docs": pa.array([*[None] * n, n_docs.tolist()], pa.list_(pa.int64())),
                }
            )
            chunk += 1

    out = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, f"chunk bigint, _key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sha string, groups string, numbers binary, often binary, pairs array<bigint>, docs array<bigint>"
    )
    return materialize(out, "aligned")


def _counted(written: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The pairs the chunks ask for (chunk, number, pair, docs), and each pair with its documents and whether no pair of its
    A id has more."""
    asked = written.where("pairs IS NOT NULL").select("chunk", F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    asked = asked.select("chunk", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("n_docs")).withColumn("a", F.expr(f"pair div {width}"))
    best = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return asked, counts.join(best, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, files: Vocabularies, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each pair of linked ids: a_id, b_id, n_docs (documents that hold it linked), best (no pair of a_id has more)."""
    width = len(_loaded(files).len_b)
    _, counts = _counted(_encoded(docs, files, key, text, False), width)
    return counts.select(F.expr(f"pair div {width}").alias("a_id"), F.expr(f"pair % {width}").alias("b_id"), "n_docs", "best")


def align(docs: DataFrame, files: Vocabularies, key: str = "doc_id", text: str = "text", with_groups: bool = True) -> DataFrame:
    """One row a document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups."""
    width = len(_loaded(files).len_b)
    written = _encoded(docs, files, key, text, with_groups)
    asked, counts = _counted(written, width)
    found = asked.join(counts, "pair").select(F.col("chunk").alias("of"), "pair", "n_docs", "best")
    columns = ["_key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]

    def summed(rows: pa.Table, found: pa.Table) -> pa.Table:
        """The rows of a chunk with what their pairs have; the chunk's own row lists its pairs in their order."""
        listed = pc.is_valid(rows.column("pairs"))
        pairs = rows.filter(listed).column("pairs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        rows = rows.filter(pc.invert(listed))
        known = found.column("pair").to_numpy()
        at = np.argsort(known)[np.searchsorted(np.sort(known), pairs)] if len(pairs) else np.zeros(0, np.int64)
        n_docs, best = found.column("n_docs").to_numpy()[at], found.column("best").to_numpy().astype(bool)[at]
        total, top = [], []
        for numbers, often in zip(rows.column("numbers").to_pylist(), rows.column("often").to_pylist(), strict=True):
            pair, times = np.cumsum(_gathered(numbers)), _gathered(often)
            total.append(int((n_docs[pair] * times).sum()))
            top.append(int(times[best[pair]].sum()))
        out = rows.append_column("n_best", pa.array(top, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))
        return out.rename_columns({"sha": "groups_sha256"}).select(columns)

    schema = f"_key {docs.schema[key].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string"
    out = written.drop("docs").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(summed, schema)
    out = out.withColumnRenamed("_key", key)
    return out if with_groups else out.drop("groups")
