"""Substring dedup by relative Lempel-Ziv parsing against blocks of reference text that content deals out.

A window is `length` consecutive words. A document is cut into pieces wherever the least hash of MARK consecutive words within the
window changes, so equal windows, wherever they stand, lie in pieces of the same anchor. The anchor deals pieces, as words with
document and position, to reference blocks: what a piece could match in any block is in its own. A block parses each piece
from left to right against the reference text of smaller ids. A match of `length` words or more becomes a phrase, which goes on along
its source, the first document and position that holds it, as long as the words agree; at a phrase's end the next windows are
checked again, so none across the boundary is missed. Hashes propose a window's source, words decide.

A document's phrases from all blocks meet again at its text, are compared with its words by digest, and those that go on along one source become
one. Spans are the words under phrases. A phrase is the longest along its first source; another source may hold a longer one.

A piece that several documents of a batch of texts hold goes to its block once, for the smallest id; for the others, all of
whose windows are duplicates, the phrase is known at once and goes by document, not by anchor, so common passages don't gather in one block.

The number of blocks follows the bytes of text. Null and empty texts have no words. Rows without an id are kept whole and aren't compared;
ids are cast to long. Rows of one id count as one document, so neither removes the other's words (a row's phrases hold for another of its id only where the words are
the same); an equal text under a larger id goes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import buckets, ship

#: Windows that a task holds before it packs them (a text is never divided), words of an anchor, bytes of text per block.
HELD, MARK, BLOCK_BYTES = 500_000, 5, 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A phrase of a document: its first word, its windows, where its source has it, and the digest of its words.
PHRASE = np.dtype([("doc", "<i8"), ("first", "<u4"), ("n", "<u4"), ("source", "<i8"), ("at", "<u4"), ("digest", "<u8")])


def _roll(each: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` consecutive ones of the given hashes."""
    n = len(each) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = each[:n].copy()
    for k in range(1, length):
        h *= _ODD
        h += each[k : k + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def window_hashes(words: list[bytes], length: int) -> np.ndarray:
    """A 64-bit hash of each window; its order in the array is the window's first word."""
    return _roll(np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64), length)


def _target(doc: np.ndarray, n: int) -> np.ndarray:
    """The group in which a document's phrases meet."""
    return ((doc.astype(np.uint64) * _ODD) >> np.uint64(33)).astype(np.int64) % n


def _ragged(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """firsts[k], firsts[k] + 1, ... counts[k] numbers each, one after the other."""
    return np.arange(counts.sum()) + np.repeat(firsts - (np.cumsum(counts) - counts), counts)


def _pack(rows: np.ndarray) -> bytes:
    """Equal bytes of all rows side by side, compressed."""
    return zstandard.compress(np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), rows.itemsize).T).tobytes(), 1)


def _unpack(raw: bytes, kind: np.dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _groups(rows: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows' numbers by key, in order of document within each."""
    order = np.lexsort((rows["doc"], key))
    at = np.flatnonzero(np.diff(key[order], prepend=-1))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
        yield int(key[order[a]]), order[a:b]


#: A piece: the document, its first word there, its windows.
_PIECE = np.dtype([("doc", "<i8"), ("first", "<u4"), ("n", "<u4")])


def cut_pieces(docs: list[int], texts: list[list[bytes]], length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Pieces of texts of at least `length` words, their anchors and their words (one space between)."""
    mark = max(1, min(MARK, length * MARK // 13))
    words = [w for t in texts for w in t]
    sizes = np.array([len(t) for t in texts])
    low, wide, have = window_hashes(words, mark), length - mark + 1, 1
    while have < wide:
        step = min(have, wide - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    counts, offsets = sizes - length + 1, np.cumsum(sizes) - sizes
    at, owner = _ragged(offsets, counts), np.repeat(np.arange(len(texts)), counts)
    low = low[at]
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (low[1:] != low[:-1])]))
    n, start, owner = np.diff(begins, append=len(at)), at[begins], owner[begins]
    pieces = np.zeros(len(begins), _PIECE)
    pieces["doc"], pieces["first"], pieces["n"] = np.array(docs, np.int64)[owner], start - offsets[owner], n
    lens = np.fromiter(map(len, words), np.int64, len(words))
    after = np.cumsum(lens + 1) - 1
    text = b" ".join(words)
    ends = after[start + n + length - 2]
    return pieces, low[begins], [text[a:b] for a, b in zip((after - lens)[start].tolist(), ends.tolist())]


def _dealt(docs: list[int], texts: list[list[bytes]], length: int, n_blocks: int) -> Iterator[tuple]:
    """block, known, packed pieces or phrases, words of the pieces."""
    if not docs:
        return
    pieces, anchor, words = cut_pieces(docs, texts, length)
    digest = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    order = np.lexsort((pieces["first"], pieces["doc"], digest))
    new = np.concatenate([[True], np.diff(digest[order]) != 0])
    least = np.empty(len(order), np.int64)
    least[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    late = np.flatnonzero(pieces["doc"] > pieces["doc"][least])
    late = late[np.fromiter((words[a] == words[b] for a, b in zip(late.tolist(), least[late].tolist())), bool, len(late))]
    known, sent = np.zeros(len(late), PHRASE), np.ones(len(pieces), bool)
    sent[late] = False
    for name, values in (("doc", pieces["doc"]), ("first", pieces["first"]), ("n", pieces["n"]), ("source", pieces["doc"][least]), ("at", pieces["first"][least]), ("digest", digest)):
        known[name] = values[late]
    for block, rows in _groups(known, _target(known["doc"], n_blocks)):
        yield block, True, _pack(known[rows]), None
    sent = np.flatnonzero(sent)
    shift = np.uint64(64 - (n_blocks.bit_length() - 1))
    for block, rows in _groups(pieces[sent], ((anchor[sent] * _ODD) >> shift).astype(np.int64)):
        rows = sent[rows]
        yield block, False, _pack(pieces[rows]), zstandard.compress(b" ".join([words[k] for k in rows.tolist()]), 1)


def _named(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of a text whose words all end with a space, equal for equal words, and where each word starts."""
    starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(text)])
    return words.dictionary_encode().indices.to_numpy(), starts


def _sources(names: np.ndarray, start: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (by number) that a smaller id also holds, and the first window with the same words. Windows are in order of document and position."""
    each = (names.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    each ^= each >> np.uint64(29)
    h = _roll(each, length)[start]
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], np.diff(h[order]) != 0])
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    late = doc[order] > doc[first]
    source = np.full(len(start), -1)
    source[order[late]] = first[late]
    found = np.flatnonzero(source >= 0)
    same = np.ones(len(found), bool)
    for k in range(length):
        same &= names[start[found] + k] == names[start[source[found]] + k]
    if not same.all():  # different words of one hash: these windows are looked up by their words
        mixed, seen = np.flatnonzero(np.isin(h, h[found[~same]])), {}
        for k in mixed.tolist():
            at = seen.setdefault(names[start[k] : start[k] + length].tobytes(), k)
            source[k] = at if doc[k] > doc[at] else -1
        found = np.flatnonzero(source >= 0)
    return found, source[found]


def parse_block(rows: list[tuple[np.ndarray, bytes]], length: int) -> np.ndarray:
    """The phrases of a block's pieces: rows hold pieces and their words (one space between)."""
    text, pieces = b" ".join([t for _, t in rows]) + b" ", np.concatenate([p for p, _ in rows])
    names, byte = _named(text)
    sizes = pieces["n"].astype(np.int64) + length - 1
    order = np.lexsort((pieces["first"], pieces["doc"]))
    offset, pieces = (np.cumsum(sizes) - sizes)[order], pieces[order]
    n = pieces["n"].astype(np.int64)
    start, piece = _ragged(offset, n), np.repeat(np.arange(len(pieces)), n)
    doc = pieces["doc"][piece]
    found, source = _sources(names, start, doc, length)
    out = np.zeros(0, PHRASE)
    if len(found):
        step = (np.diff(found) == 1) & (np.diff(source) == 1) & (np.diff(piece[found]) == 0) & (np.diff(piece[source]) == 0)
        begins = np.flatnonzero(np.concatenate([[True], ~step]))
        out = np.zeros(len(begins), PHRASE)
        a, b = found[begins], source[begins]
        out["n"] = np.diff(begins, append=len(found))
        out["doc"], out["first"] = doc[a], pieces["first"][piece[a]] + (start[a] - offset[piece[a]])
        out["source"], out["at"] = doc[b], pieces["first"][piece[b]] + (start[b] - offset[piece[b]])
        ends = start[a] + out["n"] + length - 1
        out["digest"] = [xxhash.xxh64_intdigest(text[i:j]) for i, j in zip(byte[start[a]].tolist(), (byte[ends] - 1).tolist())]
    return out


def found_phrases(df: DataFrame, id_col: str, text_col: str, length: int, n_blocks: int) -> DataFrame:
    """id, phrases (packed): where a document repeats what a smaller id holds."""
    # Phrases go from every block to every group of documents in one row: groups are fewer, as phrases are less than texts.
    n_targets = max(16, n_blocks // 4)
    kinds = {"block": pa.int32(), "known": pa.bool_(), "packed": pa.binary(), "words": pa.binary()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, texts, held = [], [], 0

        def flush():
            columns = list(zip(*_dealt(docs, texts, length, n_blocks))) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if not doc.is_valid or not text.is_valid:
                    continue
                words = text.as_py().split()
                if len(words) < length:
                    continue
                docs.append(doc.as_py())
                texts.append(words)
                held += len(words) - length + 1
                if held >= HELD:
                    yield flush()
                    docs, texts, held = [], [], 0
        yield flush()

    def parse(table: pa.Table) -> pa.Table:
        phrases, rows = [np.zeros(0, PHRASE)], []
        for known, packed, words in zip(*(table.column(c).to_pylist() for c in ("known", "packed", "words"))):
            if known:
                phrases.append(_unpack(packed, PHRASE))
            else:
                rows.append((_unpack(packed, _PIECE), zstandard.decompress(words)))
        if rows:
            phrases.append(parse_block(rows, length))
        every = np.concatenate(phrases)
        out = [(target, _pack(every[k])) for target, k in _groups(every, _target(every["doc"], n_targets))]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("target", "packed"), list(zip(*out)) or [()] * 2, (pa.int32(), pa.binary()))})

    def regroup(table: pa.Table) -> pa.Table:
        every = np.concatenate([np.zeros(0, PHRASE), *(_unpack(p, PHRASE) for p in table.column("packed").to_pylist())])
        ids, packed = [], []
        for doc, rows in _groups(every, np.unique(every["doc"], return_inverse=True)[1]):
            ids.append(int(every["doc"][rows[0]]))
            packed.append(_pack(every[rows]))
        return pa.table({"id": pa.array(ids, pa.int64()), "phrases": pa.array(packed, pa.binary())})

    source = df.select(F.col(id_col).cast("long"), F.encode(F.col(text_col), "UTF-8"))
    blocks = source.mapInArrow(deal, "block int, known boolean, packed binary, words binary")
    found = blocks.groupBy("block").applyInArrow(parse, "target int, packed binary")
    return found.groupBy("target").applyInArrow(regroup, "id bigint, phrases binary")


def joined(phrases: np.ndarray, words: list[bytes], length: int) -> list[tuple[int, int, int, int]]:
    """(first word, word after the last, source, first word there) of a text's phrases, by first word; pieces that go on along one source are one."""
    out: list[tuple[int, int, int, int]] = []
    rows = zip(*(phrases[np.argsort(phrases["first"], kind="stable")][c].tolist() for c in ("first", "n", "source", "at", "digest")))
    for first, n, source, at, digest in rows:
        after = first + n + length - 1
        if after > len(words) or xxhash.xxh64_intdigest(b" ".join(words[first:after])) != digest:
            continue  # another row of the same id
        if out and out[-1][2] == source and first - out[-1][0] == at - out[-1][3] and first <= out[-1][1] - length + 1:
            out[-1] = (out[-1][0], max(after, out[-1][1]), source, out[-1][3])
        else:
            out.append((first, after, source, at))
    return out


def factors(covered: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(first word, word after the last) of each maximal run of words under duplicate windows."""
    starts = np.flatnonzero(covered)
    out: list[tuple[int, int]] = []
    for a in starts.tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], a + length)
        else:
            out.append((a, a + length))
    return out


def n_blocks(df: DataFrame, text_col: str) -> int:
    """A power of two, at least that of the shuffle's buckets, that gives a block about BLOCK_BYTES of text."""
    total = df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(buckets(df.sparkSession), 1 << (total // BLOCK_BYTES).bit_length())


def remove_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """id, n_words, n_removed, kept_text (kept words, one space between), spans (word ranges that went) and phrases (ranges with their sources)."""
    ship(df.sparkSession)
    found = found_phrases(df, id_col, text_col, length, n_blocks(df, text_col))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press(t or b"") for t in batch.column(1).to_pylist()], pa.binary())], ["id", "packed"])

    span = pa.struct([("first", pa.int32()), ("after", pa.int32())])
    phrase = pa.struct([("first", pa.int32()), ("after", pa.int32()), ("source", pa.int64()), ("source_first", pa.int32())])
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(span), pa.list_(phrase))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for raw, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = expand(raw).split()
                parsed, spans = [], []
                if found:
                    parsed = joined(_unpack(found, PHRASE), words, length)
                    covered = np.zeros(len(words), bool)
                    for a, b, _, _ in parsed:
                        covered[a : b - length + 1] = True
                    spans = factors(covered, length)
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                told = [dict(zip(("first", "after", "source", "source_first"), p)) for p in parsed]
                for c, x in zip(rows, (len(words), len(words) - len(kept), b" ".join(kept).decode(), [{"first": a, "after": b} for a, b in spans], told)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, kinds))], [id_col, "n_words", "n_removed", "kept_text", "spans", "phrases"])

    texts = df.select(F.col(id_col).cast("long"), F.encode(F.col(text_col), "UTF-8")).mapInArrow(squeeze, "id bigint, packed binary")
    both = texts.join(found, "id", "left").select("id", "packed", "phrases")
    shape = "spans array<struct<first:int,after:int>>, phrases array<struct<first:int,after:int,source:bigint,source_first:int>>"
    return both.mapInArrow(cut_out, f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_text string, {shape}")
