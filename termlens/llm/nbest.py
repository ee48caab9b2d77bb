"""SentencePiece encoding and decoding with the N best segmentations.

The piece lattice of a text has an arc for every vocabulary piece that occurs in it, and byte arcs for a
character that no piece covers. A forward Viterbi pass gives each place the best score from the start; a search
from the end backward (A*) then uses these scores as its exact heuristic, so it takes whole segmentations from
its queue in order of score and never looks at a worse one first.

No piece of a vocabulary goes on from a letter to something that isn't one, from anything to a space, or over
a line break (checked when the vocabulary is read; characters that break the first rule don't count as letters).
So the lattice falls apart into chunks, and a text's N best are sums over chunks: apart from the best, only the
N - 1 chunks whose second best costs least can differ. A chunk's best and the cost of its second best (the best
path through an arc off the best path) are kept in a cache of bounded size; the backward search runs only for
chunks that differ.

Scores: a BPE vocabulary has ranks instead of probabilities. A piece of rank r gets the log probability that
Zipf's law gives rank r + 1, in whole millionths, so that sums are exact.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import common

#: Where the vocabulary lies unless the caller says otherwise.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Entries of each of the two generations of a worker's cache, and the longest chunk that it keeps.
CACHE, CACHED_CHARS = 400_000, 64
UNIT = 1e-6
_NEVER = -(2**62)
#: Cost of a second best that doesn't exist.
_ONE_WAY = 2**62


@dataclass
class Vocabulary:
    """An automaton of the pieces (with spaces) to (length, score, ids), the characters that are pieces, the byte
    pieces, the bytes of each id, and the pattern of chunks."""

    pieces: ahocorasick.Automaton
    covered: frozenset[str]
    byte_ids: list[int]
    byte_score: int
    raw: list[bytes]
    chunk: re.Pattern
    fresh: dict = field(default_factory=dict)
    aged: dict = field(default_factory=dict)
    ways: dict = field(default_factory=dict)


def read_vocabulary(model: bytes) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = m.get_piece_size()
    pieces = {i: m.id_to_piece(i).replace("▁", " ") for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    raw = [b""] * n
    byte_ids = [0] * 256
    for i in range(n):
        if m.is_byte(i):
            value = int(m.id_to_piece(i)[3:-1], 16)
            byte_ids[value], raw[i] = i, bytes([value])
    ranked = sorted(pieces, key=lambda i: (-m.get_score(i), i))
    norm = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
    automaton = ahocorasick.Automaton()
    for r, i in enumerate(ranked):
        raw[i] = pieces[i].encode()
        automaton.add_word(pieces[i], (len(pieces[i]), round((-math.log(r + 1) - norm) / UNIT), (i,)))
    automaton.make_automaton()
    letter = re.compile(r"[^\W\d_]")
    glue = sorted({a for p in pieces.values() for a, b in zip(p, p[1:]) if letter.match(a) and not letter.match(b) and b != " "})
    if any(re.search(r"[^ ] |.\n|\n.", p) for p in pieces.values()):
        raise ValueError("a piece of this vocabulary goes on to a space or over a line break")
    glued = re.escape("".join(glue))
    letters, other = rf"[^\W\d_{glued}]", rf"(?:[^\w \n]|[\d_{glued}])"
    # Spaces, then what isn't a letter, then letters; a line break alone.
    chunk = re.compile(rf" +{other}*{letters}*|{letters}+|\n|{other}+{letters}*")
    return Vocabulary(automaton, frozenset(p for p in pieces.values() if len(p) == 1), byte_ids, round((-math.log(len(ranked) + 1) - norm) / UNIT), raw, chunk)


def arcs(v: Vocabulary, s: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
    """For each place, the arcs that end there: (start, score, ids)."""
    into: list[list] = [[] for _ in range(len(s) + 1)]
    for end, (size, score, ids) in v.pieces.iter(s):
        into[end + 1].append((end + 1 - size, score, ids))
    if not v.covered.issuperset(s):
        for i, ch in enumerate(s):
            if ch not in v.covered:
                b = ch.encode("utf-8", "surrogatepass")
                into[i + 1].append((i, v.byte_score * len(b), tuple(v.byte_ids[x] for x in b)))
    return into


def forward(into: list[list]) -> list[int]:
    """Best score from the start to each place."""
    best = [0] + [_NEVER] * (len(into) - 1)
    for j in range(1, len(into)):
        best[j] = max(best[i] + score for i, score, _ in into[j])
    return best


def n_best(v: Vocabulary, s: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The ``n`` best segmentations of a string as (score, ids), by backward A*; of equals, the first found."""
    into = arcs(v, s)
    best = forward(into)
    # Of equal scores the one nearest to the start goes first: many equal ways don't hold up the first whole ones.
    agenda, count, out = [(-best[-1], len(s), 0, 0, None)], 0, []
    while agenda and len(out) < n:
        minus, j, _, g, path = heapq.heappop(agenda)
        if j == 0:
            ids = []
            while path:
                ids.extend(path[0])
                path = path[1]
            out.append((-minus, tuple(ids)))
            continue
        for i, score, piece in into[j]:
            count += 1
            heapq.heappush(agenda, (-(g + score + best[i]), i, count, g + score, (piece, path)))
    return out


def _chunk(v: Vocabulary, s: str) -> tuple[bytes, int, int]:
    """Ids (32 bits each) and score of a chunk's best segmentation, and what the second best costs more.

    One pass forward over the arcs by their ends, one back: an arc off the best path, with the best ways to its
    start and from its end, is the best that takes it.
    """
    n = len(s)
    best, back = [0] + [_NEVER] * n, [None] * (n + 1)
    if v.covered.issuperset(s):
        flat = [(end + 1 - x[0], end + 1, x[1], x[2]) for end, x in v.pieces.iter(s)]
    else:
        flat = [(i, j, score, ids) for j, ends in enumerate(arcs(v, s)) for i, score, ids in ends]
    for arc in flat:
        i, j, score, _ = arc
        x = best[i] + score
        if x > best[j]:
            best[j], back[j] = x, arc
    on: list = [None] * (n + 1)
    ids: tuple[int, ...] = ()
    j = n
    while j:
        arc = on[j] = back[j]
        ids = arc[3] + ids if n <= CACHED_CHARS else ids
        j = arc[0]
    if n > CACHED_CHARS:  # long chunks: no adding of tuples again and again
        ids = tuple(x for arc in on if arc for x in arc[3])
    tail = [_NEVER] * n + [0]
    top = _NEVER
    for arc in reversed(flat):
        i, j, score, _ = arc
        y = tail[j] + score
        if y > tail[i]:
            tail[i] = y
        if on[j] is not arc and best[i] + y > top:
            top = best[i] + y
    found = (np.array(ids, np.int32).tobytes(), best[n], best[n] - top if top > _NEVER // 2 else _ONE_WAY)
    if n <= CACHED_CHARS:
        _keep(v, s, found)
    return found


def _recall(v: Vocabulary, s: str) -> tuple | None:
    """What the older generation knows of a chunk, moved to the younger one."""
    found = v.aged.pop(s, None)
    if found is not None:
        _keep(v, s, found)
    return found


def _keep(v: Vocabulary, s: str, found: tuple) -> None:
    if len(v.fresh) >= CACHE:
        v.aged, v.fresh = v.fresh, {}
    v.fresh[s] = found


def _ways(v: Vocabulary, s: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
    found = v.ways.get((s, n))
    if found is None:
        found = n_best(v, s, n)
        if len(s) <= CACHED_CHARS:
            if len(v.ways) >= CACHE // 10:
                v.ways.clear()
            v.ways[s, n] = found
    return found


def encode(v: Vocabulary, text: str, n: int = N_BEST) -> tuple[np.ndarray, list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]]]:
    """Ids of the best segmentation, and the ``n`` best as (score, edits); an edit is (start, drop, ids) on the best's ids.

    A space stands before the text, as the vocabulary's pieces expect. The empty text has no ids and one
    segmentation of score 0.
    """
    if not text:
        return np.zeros(0, np.int32), [(0, [])]
    chunks = v.chunk.findall(" " + text)
    found = list(map(v.fresh.get, chunks))
    if None in found:
        for k, f in enumerate(found):
            if f is None:
                s = chunks[k]
                found[k] = v.fresh.get(s) or _recall(v, s) or _chunk(v, s)
    parts, scores, costs = zip(*found)
    total = sum(scores)
    ids = np.frombuffer(b"".join(parts), np.int32)
    cost = np.array(costs)
    near = np.argpartition(cost, n - 2)[: n - 1] if len(cost) >= n > 1 else np.arange(len(cost))
    if len(cost) >= n > 1:  # of chunks of equal cost, the first ones
        edge = cost[near].max()
        near = np.concatenate([np.flatnonzero(cost < edge), np.flatnonzero(cost == edge)])[: n - 1]
    least = sorted(k for k in near.tolist() if costs[k] < _ONE_WAY)
    combos: list[tuple[int, tuple]] = [(0, ())]
    for k in least:
        ways = _ways(v, chunks[k], n)
        combos = heapq.nsmallest(n, ((cost + ways[0][0] - score, (*edits, (k, way)) if r else edits) for cost, edits in combos for r, (score, way) in enumerate(ways)), key=lambda c: c[0])
    starts = np.cumsum([0, *(len(p) // 4 for p in parts)]) if len(combos) > 1 else []
    return ids, [(total - cost, [(int(starts[k]), len(parts[k]) // 4, way) for k, way in edits]) for cost, edits in combos]


def decode(v: Vocabulary, ids) -> str:
    """The text of a sequence of ids; bytes that aren't UTF-8 become replacement characters."""
    return b"".join(map(v.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")[1:] if len(ids) else ""


_HELD: dict[int, Vocabulary] = {}


def _vocabulary(model: bytes) -> Vocabulary:
    """One for a worker and model, with its cache."""
    key = hash(model)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = read_vocabulary(model)
    return _HELD[key]


_EDITS = "array<struct<start:int,drop:int,ids:array<int>>>"


def encode_texts(docs: DataFrame, model: str = MODEL, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_pieces, score, ids, alternatives, round_trip)`` for each row.

    ``ids``: the best segmentation; ``alternatives``: the others of the N best, each as its score and its edits
    (from ``start``, ``drop`` ids give way to ``ids``); ``round_trip``: whether decoding gives the text back. Null
    texts count as empty; null ids and repeated rows keep their row; an empty table gives an empty result; long texts are segmented
    whole, since the lattice is split only where no piece crosses; other columns aren't looked at. The vocabulary
    (at most a few MB) is read on the driver.
    """
    with open(model, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    schema = pa.schema([("id", pa.int64()), ("n_pieces", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int32())), ("alternatives", _WAYS), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(sent.value)
        for batch in batches:
            held, chars = [], 0
            for row_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                ids, ways = encode(v, text, n)
                held.append((row_id.as_py(), ids, ways, decode(v, ids) == text))
                chars += len(text)
                if chars > 2_000_000:
                    yield _batch(held, schema)
                    held, chars = [], 0
            yield _batch(held, schema)
        v.aged.clear()  # the worker lives on: what other stages need isn't held by old entries

    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id long, n_pieces long, score double, ids array<int>, alternatives array<struct<score:double,edits:{_EDITS}>>, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


_WAYS = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("start", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows (id, ids, ways, round trip) as columns; the ids of all rows are one array with offsets."""
    offsets = np.cumsum([0, *(len(h[1]) for h in held)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int32), *(h[1] for h in held)])
    others = [[{"score": s * UNIT, "edits": [{"start": a, "drop": d, "ids": i} for a, d, i in edits]} for s, edits in h[2][1:]] for h in held]
    columns = [pa.array([h[0] for h in held], pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array([h[2][0][0] * UNIT for h in held], pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(others, _WAYS), pa.array([h[3] for h in held], pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def decode_ids(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)``: the text of each row's ids (null ids: null)."""
    with open(model, "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = _vocabulary(sent.value)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "text": [None if x is None else decode(v, x) for x in batch["ids"]]}).astype({"id": "Int64"})

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, "id long, text string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_nbest``: every whole text of ``documents`` with its four best segmentations."""
    return encode_texts(common.read(spark, sf_dir, "documents"))
