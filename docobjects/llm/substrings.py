"""Exact removal of repeated 100-byte strings by a sparse, hash-compared suffix sort.

Every 100-byte window is assigned to an anchor: the leftmost of its 24-byte strings with the least hash. Equal windows have
equal anchors at equal places, so windows are only compared within the context around an anchor. Contexts that repeat as a
whole are found by their hashes, in a block verified byte by byte, across blocks by hashes alone. For the others, the windows of equal anchor and place
are sorted as suffixes: a mergesort whose comparisons find the common extension by binary search over prefix
polynomial hashes; runs of equal suffixes are verified byte by byte, and all but the first occurrence are removed.
Anchors with very many contexts are settled window by window, dealt by the window's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ..lineage import steady, width
from .kernels import POWERS, U64, Powers, blocks, gaps, home_key, mix, narrow, pack, prefix_hash, range_hash, release, text_bytes, unpack

#: Bytes of an anchor.
ANCHOR = 24
#: Bytes of text in a block, and in the slices that are hashed at once.
BLOCK, SLICE = 8 << 20, 1 << 19
#: Distinct contexts of an anchor from which its windows are dealt by their own hashes.
HOT = 256
#: Sorts after every id.
LAST = (1 << 63) - 1

SECOND = Powers(0xC2B2AE3D27D4EB4F)
ROWS = pa.schema([("key", pa.int32()), ("block", pa.string()), ("kind", pa.int32()), ("body", pa.binary())])
ROWS_DDL = "key int, block string, kind int, body binary"
#: Kinds of rows: questions and answers about anchors, contexts and windows; a block's documents; results.
ANCHORS, CONTEXTS, WINDOWS, DOCUMENTS, DONE = range(5)
_SQUEEZE = zstandard.ZstdCompressor(level=7)


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), ROWS, strict=True)] if rows else [pa.array([], t.type) for t in ROWS], schema=ROWS)


def _key(hashes: np.ndarray, keys: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(keys)) >> U64(32)


def spread(grams: np.ndarray) -> np.ndarray:
    """Anchors are least hashes, so they crowd at the low end; mixed once more they are even."""
    return mix(grams + U64(0x632BE59BD9B4E019))


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor hash, context hash, first and last window, first window to anchor, document."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, U64) for _ in range(2)) + tuple(np.zeros(0, np.int64) for _ in range(4))
    span = length - ANCHOR + 1
    prefix, at = prefix_hash(data), np.arange(n - ANCHOR + 1)
    grams = mix(range_hash(prefix, at, at + ANCHOR))
    bits = U64(max(int(n).bit_length(), 24))
    least = (grams >> bits << bits) | at.astype(U64)
    reach = 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    anchor = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
    window = np.arange(len(anchor))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    fits = window + length <= offsets[doc + 1]
    window, anchor, doc = window[fits], anchor[fits], doc[fits]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1 if len(first) else first
    low, high, anchor, doc = window[first], window[last], anchor[first], doc[first]
    other = prefix_hash(data, SECOND)
    context = mix(range_hash(other, low, high + length, SECOND) + (anchor - low).astype(U64) * U64(1000003) + (anchor - high).astype(U64) * U64(7919))
    return spread(grams[anchor]), context, low, high, anchor - low, doc


def hashes_at(data: np.ndarray, start: np.ndarray, length: int, powers: Powers = POWERS) -> np.ndarray:
    """Hashes of data[start:start+length], worked out slice by slice."""
    out, order = np.empty(len(start), dtype=U64), np.argsort(start, kind="stable")
    edges = np.searchsorted(start[order], np.arange(0, len(data) + SLICE, SLICE))
    for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if j > i:
            own, base = order[i:j], k * SLICE
            at = start[own] - base
            out[own] = range_hash(prefix_hash(data[base : base + SLICE + length], powers), at, at + length, powers)
    return out


def window_hashes(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """64 + 32 bits of hash of data[start:start+length]."""
    return mix(hashes_at(data, start, length)), (mix(hashes_at(data, start, length, SECOND) + U64(1)) >> U64(32)).astype(np.uint32)


def suffix_sort(data: np.ndarray, start: np.ndarray, segment: np.ndarray, length: int, powers: Powers = POWERS) -> tuple[np.ndarray, np.ndarray]:
    """Stable mergesort, within each segment (ascending), of the suffixes of data at `start`, by `length` bytes.

    All merges of a level run at once: each element finds its rank in the other half by binary search, each comparison
    its common extension by binary search over prefix hashes. Returns the order, and whether each sorted suffix equals
    the one before it in its segment, verified byte by byte; if a hash has lied, the sort is done again with
    another base.
    """
    n, base = len(start), 0
    prefix = prefix_hash(data, powers)
    down = powers.upto(len(prefix))[1]

    def piece(x: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (prefix[x + size] - prefix[x]) * down[x]

    def extension(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), length)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = piece(a, middle) == piece(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    order = np.arange(n)
    new = np.ones(n, dtype=bool)
    new[1:] = segment[1:] != segment[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    low_of, high_of = np.repeat(first, size), np.repeat(first + size, size)
    step, largest = 1, int(size.max()) if n else 0
    while step < largest:
        slot = np.flatnonzero(high_of - low_of > step)
        offset = slot - low_of[slot]
        part = offset // step
        begin = low_of[slot] + (part ^ 1) * step
        there = begin < high_of[slot]
        slot, offset, part, begin = slot[there], offset[there], part[there], begin[there]
        low, high = begin.copy(), np.minimum(begin + step, high_of[slot])
        own, right = start[order[slot]], part % 2 == 1
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            other, mine = start[order[middle]], own[open_]
            common = extension(other, mine)
            ended = common == length
            x, y = data[np.minimum(other + common, len(data) - 1)], data[np.minimum(mine + common, len(data) - 1)]
            before = np.where(ended, right[open_], x < y)
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        merged = order.copy()
        merged[low_of[slot] + (part & ~1) * step + (offset - part * step) + low - begin] = order[slot]
        order, step = merged, step * 2
    equal = np.zeros(n, dtype=bool)
    if n > 1:
        a, b = start[order[:-1]], start[order[1:]]
        full = np.full(n - 1, length)
        equal[1:] = ~new[1:] & (piece(a, full) == piece(b, full))
    hit = np.flatnonzero(equal)
    for i in range(0, len(hit), 1 << 16):
        a, b = start[order[hit[i : i + (1 << 16)] - 1]], start[order[hit[i : i + (1 << 16)]]]
        if not (data[a[:, None] + np.arange(length)] == data[b[:, None] + np.arange(length)]).all():
            base = (powers.base * 3 + 2) | 1
            break
    return suffix_sort(data, start, segment, length, Powers(base)) if base else (order, equal)


def finish(data: np.ndarray, offsets: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[list, ...]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each document when the byte ranges low:high go."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    removed, spans, digests, i = [], [], [], 0
    while i < len(offsets) - 1:
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1), len(offsets) - 1)
        base, own = offsets[i], offsets[i : j + 1] - offsets[i]
        a, b = np.searchsorted(low, [offsets[i], offsets[j]])
        part, n = data[base : offsets[j]], int(own[-1])
        gone = np.cumsum(np.bincount(low[a:b] - base, minlength=n + 1)[:n] - np.bincount(high[a:b] - base, minlength=n + 1)[:n]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = own[:-1][own[:-1] < n]
        begins[inner] = gone[inner]
        for out, marks in ((removed, gone), (spans, begins)):
            total = np.concatenate([[0], np.cumsum(marks)])
            out.append(total[own[1:]] - total[own[:-1]])
        for x, y, lost in zip(own[:-1], own[1:], removed[-1], strict=True):
            digests.append(hashlib.sha256((part[x:y][~gone[x:y]] if lost else part[x:y]).tobytes()).hexdigest())
        i = j
    return np.diff(offsets), np.concatenate(removed), np.concatenate(spans), digests


def _results(ids: np.ndarray, valid: np.ndarray, figures: tuple) -> bytes:
    n_bytes, n_removed, n_spans, digests = figures
    return pack(ids, valid, narrow(n_bytes), narrow(n_removed), narrow(n_spans), np.frombuffer(bytes.fromhex("".join(digests)), np.uint8))


def _squeeze(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(_SQUEEZE.compress(np.ascontiguousarray(data)), np.uint8)


def _text(squeezed: np.ndarray) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(squeezed.tobytes()), np.uint8)


def _first_of_runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the columns (the first is the most significant, the last the order in a run), and whether each
    sorted element is the first of its run of equal columns but the last."""
    order = np.lexsort(columns[::-1])
    first = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        same = np.ones(len(order) - 1, dtype=bool)
        for c in columns[:-1]:
            same &= c[order][1:] == c[order][:-1]
        first[1:] = ~same
    return order, first


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] and data[b:b+size] are equal, byte by byte."""
    out, upto, i = np.zeros(len(a), dtype=bool), np.cumsum(size), 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SLICE, side="right")))
        own = size[i:j]
        first = np.cumsum(own) - own
        step = np.arange(int(own.sum()))
        equal = data[np.repeat(a[i:j] - first, own) + step] == data[np.repeat(b[i:j] - first, own) + step]
        out[i:j] = np.logical_and.reduceat(equal, first)
        i = j
    return out


def repeats_in_block(data: np.ndarray, gram: np.ndarray, context: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of a block's contexts, whether each is the first of its hashes, and the contexts' hashes: one whose bytes differ from
    the first of its hashes gets a hash of its own, so that it is compared like any other."""
    while True:
        order, first = _first_of_runs(gram, context, low)
        head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
        again = np.flatnonzero(~first)
        a, b = head[again], order[again]
        span = high[b] - low[b]
        lied = high[a] - low[a] != span
        lied[~lied] = ~same_bytes(data, low[a[~lied]], low[b[~lied]], span[~lied] + length)
        if not lied.any():
            return order, first, context
        context = context.copy()
        context[b[lied]] = mix(context[b[lied]] + low[b[lied]].astype(U64) + U64(1))


def _ask(keys: int, length: int):
    """Blocks in the order of their ids: the first anchor of each context is asked about, later ones are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                ids = block.column(0)
                valid = np.asarray(ids.is_valid())
                plain = np.where(valid, np.asarray(ids.fill_null(0)).astype(np.int64), LAST)
                order = np.argsort(plain, kind="stable")
                block, plain, valid = block.take(pa.array(order)), plain[order], valid[order]
                data, offsets = text_bytes(block.column(1))
                found, at = [], 0
                for part in blocks(block, "text", SLICE):
                    x, o = text_bytes(part.column(1))
                    gram, context, low, high, lead, doc = anchors_of(x, o, length)
                    found.append((gram, context, low + offsets[at], high + offsets[at], lead, doc + at))
                    at += part.num_rows
                gram, context, low, high, lead, doc = (np.concatenate(x) for x in zip(*found, strict=True))
                name = f"{TaskContext.get().partitionId():07d}.{number:05d}"
                number += 1
                order, first, context = repeats_in_block(data, gram, context, low, high, length)
                again, order = order[~first], order[first]
                edges = np.searchsorted(_key(gram[order], keys), np.arange(keys + 1))
                rows = []
                for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    if j > i:
                        own = order[i:j]
                        rows.append((k, name, ANCHORS, pack(gaps(gram[own]), context[own] >> U64(16), plain[doc[own]], narrow(low[own]))))
                body = pack(plain, valid, narrow(np.diff(offsets)), _squeeze(data), narrow(low[again]), narrow(high[again] - low[again]), narrow(low[order]), narrow(high[order] - low[order]), narrow(lead[order]))
                rows.append((home_key(name, keys), name, DOCUMENTS, body))
                yield from _rows(rows).to_batches()

    return run


def _settle_anchors(table: pa.Table) -> pa.Table:
    """All anchors of a range of hashes: 0 new, 1 a repeated context, 2 to be compared by context, 3 by window."""
    rows, asks = [], []
    for key, block, kind, body in zip(*(table.column(c).to_pylist() for c in ROWS.names), strict=True):
        if kind == ANCHORS:
            asks.append((block, key, unpack(body)))
        else:
            rows.append((key, block, kind, body))
    asks.sort(key=lambda a: a[0])
    if asks:
        gram, context, ids, low = (np.concatenate([np.cumsum(a[2][0]) if i == 0 else a[2][i].astype(np.uint64 if i == 1 else np.int64) for a in asks]) for i in range(4))
        size = [len(a[2][0]) for a in asks]
        place = np.lexsort((low, np.repeat(np.arange(len(asks)), size), ids))
        turn = np.empty_like(place)
        turn[place] = np.arange(len(place))
        order, first = _first_of_runs(gram, context, turn)
        group = np.cumsum(np.concatenate([[True], gram[order][1:] != gram[order][:-1]])) - 1
        contexts = np.bincount(group, weights=first)[group]
        state = np.empty(len(order), dtype=np.uint8)
        state[order] = np.where(~first, 1, np.where(contexts == 1, 0, np.where(contexts < HOT, 2, 3)))
        edge = np.cumsum([0, *size])
        rows += [(key, block, ANCHORS, pack(state[edge[i] : edge[i + 1]])) for i, (block, key, _) in enumerate(asks)]
    return _rows(rows)


def _ask_contexts(keys: int, length: int):
    """A block with all its anchors' states: settles what it can, asks about the contexts and windows that are left."""

    def run(table: pa.Table) -> pa.Table:
        release()
        head, answers = None, []
        for key, name, kind, body in zip(*(table.column(c).to_pylist() for c in ROWS.names), strict=True):
            block = name
            if kind == DOCUMENTS:
                home, head = key, unpack(body)
            else:
                answers.append((key, unpack(body)[0]))
        ids, valid, sizes, squeezed, low_again, high_again, low, high, lead = head
        state = np.concatenate([x for _, x in sorted(answers, key=lambda a: a[0])]) if answers else np.zeros(0, np.uint8)
        low, lead, low_again = low.astype(np.int64), lead.astype(np.int64), low_again.astype(np.int64)
        high, high_again = low + high, low_again + high_again
        data, offsets = _text(squeezed), np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        doc_of = lambda p: np.searchsorted(offsets, p, side="right") - 1
        open_docs = np.zeros(len(ids), dtype=bool)
        open_docs[doc_of(low[state >= 2])] = True
        gone_low = np.concatenate([low_again, low[state == 1]])
        gone_high = np.concatenate([high_again, high[state == 1]]) + length
        rows = []
        # Documents without open questions are done.
        in_open = np.repeat(open_docs, np.diff(offsets))

        def part(mask: np.ndarray, bytes_: np.ndarray) -> tuple:
            """Text, offsets and gone ranges of some of the documents, and how far each document moves."""
            own = np.where(mask, np.diff(offsets), 0)
            new = np.cumsum(own) - own
            move = new - offsets[:-1]
            d = doc_of(gone_low) if len(gone_low) else np.zeros(0, np.int64)
            keep = mask[d]
            return data[bytes_], np.concatenate([[0], np.cumsum(own[mask])]), gone_low[keep] + move[d[keep]], gone_high[keep] + move[d[keep]], move

        if not open_docs.all():
            text, offs, a, b, _ = part(~open_docs, ~in_open)
            rows.append((home, block, DONE, _results(ids[~open_docs], valid[~open_docs], finish(text, offs, a, b))))
        if open_docs.any():
            text, offs, a, b, move = part(open_docs, in_open)
            docs = doc_of(low)
            low, high = low + move[docs], high + move[docs]
            ids_of = ids[docs]
            cold = np.flatnonzero(state == 2)
            gram = spread(mix(hashes_at(text, low[cold] + lead[cold], ANCHOR)))
            order = np.argsort(gram, kind="stable")
            cold, gram = cold[order], gram[order]
            edges = np.searchsorted(_key(gram, keys), np.arange(keys + 1))
            for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if j > i:
                    own = cold[i:j]
                    span = high[own] - low[own] + length
                    take = np.repeat(low[own] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
                    rows.append((k, block, CONTEXTS, pack(gaps(gram[i:j]), narrow(high[own] - low[own]), narrow(lead[own]), ids_of[own], narrow(low[own]), text[take])))
            hot = np.flatnonzero(state == 3)
            span = high[hot] - low[hot] + 1
            window = np.repeat(low[hot] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
            owner = np.repeat(ids_of[hot], span)
            value, check = window_hashes(text, window, length)
            order, first = _first_of_runs(value, check, window)
            repeated = window[order[~first]]
            order = order[first]
            edges = np.searchsorted(_key(value[order], keys), np.arange(keys + 1))
            for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if j > i:
                    own = order[i:j]
                    rows.append((k, block, WINDOWS, pack(gaps(value[own]), check[own], owner[own], narrow(window[own]))))
            a, b = np.concatenate([a, repeated]), np.concatenate([b, repeated + length])
            body = pack(ids[open_docs], valid[open_docs], narrow(np.diff(offs)), _squeeze(text), narrow(a), narrow(b), narrow(low[cold]), narrow(high[cold] - low[cold]), narrow(window[order]))
            rows.append((home, block, DOCUMENTS, body))
        return _rows(rows)

    return run


def _settle_contexts(length: int):
    """All contexts and windows of a range of hashes: which windows repeat an earlier one."""

    def run(table: pa.Table) -> pa.Table:
        rows, contexts, windows = [], [], []
        for key, block, kind, body in zip(*(table.column(c).to_pylist() for c in ROWS.names), strict=True):
            if kind == CONTEXTS:
                contexts.append((block, key, unpack(body)))
            elif kind == WINDOWS:
                windows.append((block, key, unpack(body)))
            else:
                rows.append((key, block, kind, body))
        contexts.sort(key=lambda a: a[0]), windows.sort(key=lambda a: a[0])
        if contexts:
            column = lambda i: np.concatenate([a[2][i].astype(np.int64) for a in contexts])
            gram = np.concatenate([np.cumsum(a[2][0]) for a in contexts])
            more, lead, ids, low = (column(i) for i in range(1, 5))
            data = np.concatenate([a[2][5] for a in contexts])
            begin = np.cumsum(more + length) - (more + length)
            number = [len(a[2][0]) for a in contexts]
            place = np.lexsort((low, np.repeat(np.arange(len(contexts)), number), ids))
            turn = np.empty_like(place)
            turn[place] = np.arange(len(place))
            count = more + 1
            of = np.repeat(np.arange(len(gram)), count)
            step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            offset = lead[of] - step
            group = np.unique(gram, return_inverse=True)[1][of]
            order = np.lexsort((turn[of], offset, group))
            segment = np.cumsum(np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (offset[order][1:] != offset[order][:-1])])) - 1
            several = (np.bincount(segment) > 1)[segment]
            order, segment = order[several], segment[several]
            sorted_, equal = suffix_sort(data, (begin[of] + step)[order], segment, length)
            gone = np.zeros(len(of), dtype=bool)
            gone[order[sorted_[equal]]] = True
            edge = np.concatenate([[0], np.cumsum(np.add.reduceat(count, np.cumsum([0, *number[:-1]])))])
            rows += [(key, block, CONTEXTS, pack(np.packbits(gone[edge[i] : edge[i + 1]]), np.array([edge[i + 1] - edge[i]]))) for i, (block, key, _) in enumerate(contexts)]
        if windows:
            value = np.concatenate([np.cumsum(a[2][0]) for a in windows])
            check, ids, at = (np.concatenate([a[2][i].astype(np.int64) for a in windows]) for i in range(1, 4))
            number = [len(a[2][0]) for a in windows]
            place = np.lexsort((at, np.repeat(np.arange(len(windows)), number), ids))
            turn = np.empty_like(place)
            turn[place] = np.arange(len(place))
            order, first = _first_of_runs(value, check, turn)
            gone = np.zeros(len(order), dtype=bool)
            gone[order] = ~first
            edge = np.cumsum([0, *number])
            rows += [(key, block, WINDOWS, pack(np.packbits(gone[edge[i] : edge[i + 1]]), np.array([number[i]]))) for i, (block, key, _) in enumerate(windows)]
        return _rows(rows)

    return run


RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish_block(length: int):
    """A block with all answers: its documents' results."""

    def run(table: pa.Table) -> pa.Table:
        release()
        done, head, answers = [], None, {CONTEXTS: [], WINDOWS: []}
        for key, kind, body in zip(*(table.column(c).to_pylist() for c in ("key", "kind", "body")), strict=True):
            if kind == DONE:
                done.append(unpack(body))
            elif kind == DOCUMENTS:
                head = unpack(body)
            else:
                bits, count = unpack(body)
                answers[kind].append((key, np.unpackbits(bits, count=int(count[0])).astype(bool)))
        if head is not None:
            ids, valid, sizes, squeezed, low, high, context_low, context_more, window = head
            gone = {k: np.concatenate([x for _, x in sorted(v, key=lambda a: a[0])]) if v else np.zeros(0, bool) for k, v in answers.items()}
            count = context_more.astype(np.int64) + 1
            start = np.repeat(context_low.astype(np.int64) - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            start = np.concatenate([start[gone[CONTEXTS]], window.astype(np.int64)[gone[WINDOWS]]])
            offsets = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
            figures = finish(_text(squeezed), offsets, np.concatenate([low.astype(np.int64), start]), np.concatenate([high.astype(np.int64), start + length]))
            done.append(unpack(_results(ids, valid, figures)))
        ids, valid, n_bytes, n_removed, n_spans = (np.concatenate([d[i].astype(np.int64) for d in done]) for i in range(5))
        digest = b"".join(d[5].tobytes() for d in done)
        hexes = [digest[i : i + 32].hex() for i in range(0, len(digest), 32)]
        return pa.table({"doc_id": pa.array(ids, mask=valid == 0), "n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": pa.array(hexes, pa.string())})

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """Removes each byte that a `length`-byte string covers which also starts earlier: in a smaller id, or earlier in the
    same text. Strings are judged on the input; matches do not cross texts; overlaps count.

    A null or empty text, and one shorter than `length`, loses nothing. Null ids stand after all others; rows that
    repeat an id stand in the order of the scan. Very long texts are blocks of their own. An empty table gives an empty result;
    other columns are not read. Ids must be integers; `length` must be more than ANCHOR and below 256.

    One row per row of df: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.
    """
    if not ANCHOR < length < 256:
        raise ValueError(f"length must lie between {ANCHOR + 1} and 255")
    keys = 8 * width(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = steady(docs).mapInArrow(_ask(keys, length), ROWS_DDL)
    settled = asked.groupBy("key").applyInArrow(_settle_anchors, ROWS_DDL)
    left = settled.groupBy("block").applyInArrow(_ask_contexts(keys, length), ROWS_DDL)
    compared = left.groupBy("key").applyInArrow(_settle_contexts(length), ROWS_DDL)
    return compared.groupBy("block").applyInArrow(_finish_block(length), RESULT_DDL)
