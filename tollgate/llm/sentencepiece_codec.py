"""SentencePiece encoding and decoding: an Aho-Corasick automaton over pieces drives a Viterbi search.

The pieces and scores of a public vocabulary file are used as they are (nothing is
trained).  The automaton reads each position once; the state's output, and the outputs its
suffix links lead to, are exactly the pieces that end there, and each relaxes the best
score at that position.  The path of greatest total score wins; of equal ones, the longer
last piece.  A character without a piece of its own costs ten below the worst score and is
written as the byte pieces of its UTF-8 form.

No piece holds a blank after another character, so the search splits at the starts of
blank runs, and around characters that no piece holds, without changing its result.  Distinct segments are searched once, all of a
batch side by side (numpy over segments, one step per position; a few very long ones one by
one, in time linear in their length), and cached per Python
worker up to a bound; a cached segment is compared byte by byte, not by hash alone.  A vocabulary whose pieces do cross blanks is searched whole.

Normalisation is the file's own identity rule: blanks become U+2581, one is put in front,
nothing else changes.  Decoding undoes it; U+2581 in a text comes back as a blank, and
bytes that are not UTF-8 as U+FFFD.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated
rows get equal ids; null ids decode to the empty text; very long texts and very long words
are searched whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes
from .words import WordTable

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_SEGMENTS, SEGMENT_BYTES, SIDE_BY_SIDE = 800_000, 4 << 20, 1 << 19
FEW, LONG = 24, 256  # at most so many segments longer than this are searched one by one
_codecs: dict[str, Codec] = {}


class Automaton:
    """Aho-Corasick over code points; transitions sorted by (state, character)."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        chars = sorted({c for p in pieces for c in p})
        self.width = len(chars) + 1  # 0: a character that no piece holds
        code = {c: i + 1 for i, c in enumerate(chars)}
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = range(1, self.width)
        children: list[dict[int, int]] = [{}]
        self.piece = [-1]
        for p, (number, _) in pieces.items():
            s = 0
            for c in p:
                nxt = children[s].get(code[c])
                if nxt is None:
                    nxt = children[s][code[c]] = len(children)
                    children.append({})
                    self.piece.append(-1)
                s = nxt
            self.piece[s] = number
        fail, link = [0] * len(children), [0] * len(children)  # link: the longest proper suffix that is a piece
        queue = deque(children[0].values())
        while queue:
            s = queue.popleft()
            link[s] = fail[s] if self.piece[fail[s]] >= 0 else link[fail[s]]
            for c, nxt in children[s].items():
                f = fail[s]
                while f and c not in children[f]:
                    f = fail[f]
                fail[nxt] = children[f].get(c, 0)
                queue.append(nxt)
        self.piece, self.fail, self.link = (np.array(x, np.int64) for x in (self.piece, fail, link))
        keys = np.array([s * self.width + c for s, edges in enumerate(children) for c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array([n for edges in children for n in edges.values()], np.int64)[order]

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next states: along failure links until a transition exists or the root is reached."""
        out = np.zeros(len(state), np.int64)
        todo, at = np.arange(len(state)), state
        while len(todo):
            key = at * self.width + char[todo]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            out[todo[hit]] = self.to[k[hit]]
            again = ~hit & (at > 0)
            todo, at = todo[again], self.fail[at[again]]
        return out


class Codec:
    def __init__(self, pieces: list[tuple[str, float, str]]):
        """``pieces``: (text, score, kind) by id; kind is normal, byte, unknown or control."""
        normal = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind == "normal" and p}
        self.automaton = Automaton(normal)
        self.score = np.array([s for _, s, _ in pieces], float)
        self.length = np.array([len(p) for p, _, _ in pieces], np.int64)
        self.unknown = float(min((s for _, s in normal.values()), default=0.0)) - UNKNOWN_PENALTY
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown_id = next((i for i, x in enumerate(pieces) if x[2] == "unknown"), 0)
        self.raw = [bytes([int(p[3:5], 16)]) if kind == "byte" else p.replace(BLANK, " ").encode() if kind == "normal"
                    else " ⁇ ".encode() if kind == "unknown" else b"" for p, _, kind in pieces]
        self.byte_ids = np.array([self.bytes.get(b, self.unknown_id) for b in range(256)])
        self.splits = not any(BLANK in p.lstrip(BLANK) for p in normal)
        # characters below 128 that no piece holds stand alone (a blank is written as U+2581)
        self.lone = np.array([b < 128 and b != 32 and not self.automaton.code[b] for b in range(256)])
        self.segments = WordTable(CACHE_SEGMENTS)
        self._clear()

    @classmethod
    def load(cls, path: str) -> Codec:
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [("unknown" if m.is_unknown(i) else "control" if m.is_control(i) else "byte" if m.is_byte(i) else "unused" if m.is_unused(i) else "normal")
                 for i in range(m.vocab_size())]
        return cls([(m.id_to_piece(i), m.get_score(i), kinds[i]) for i in range(m.vocab_size())])

    def _clear(self) -> None:
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.total = np.empty(0, np.uint32), np.empty(0, float)

    def viterbi(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, at, size, score): segment i, blanks written as U+2581, has ids[at[i]:at[i]+size[i]]."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(lengths, kind="stable")
        sizes, totals, parts, i = np.zeros(len(segments), np.int64), np.zeros(len(segments)), [], 0
        while i < len(order):  # segments of like length, side by side
            room = np.flatnonzero((np.arange(1, len(order) - i + 1)) * (lengths[order[i:]] + 1) > SIDE_BY_SIDE)
            group = order[i : i + max(int(room[0]) if len(room) else len(order), 1)]
            texts = [segments[g] for g in group.tolist()]
            ids, size, score = self._in_turn(texts) if len(group) <= FEW and lengths[group[0]] > LONG else self._together(texts, lengths[group])
            parts.append(ids)
            sizes[group], totals[group] = size, score
            i += len(group)
        at = np.zeros(len(segments), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([np.empty(0, np.uint32), *parts]), at, sizes, totals

    def _together(self, segments: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, ids of each, scores) of segments sorted by length."""
        n, longest = len(segments), int(sizes[-1])
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        code = self.automaton.code[points]
        first = np.cumsum(sizes) - sizes
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        came = np.full((longest + 1, n), -1, np.int32)  # the last piece; -1: an unknown character
        state = np.zeros(n, np.int64)
        for t in range(longest):
            low = int(np.searchsorted(sizes, t, "right"))  # segments from here on have a character t
            state[low:] = self.automaton.step(state[low:], code[first[low:] + t])
            here = np.full(n - low, -np.inf)
            by = np.full(n - low, -1, np.int32)
            alone = np.zeros(n - low, bool)
            at = state[low:]
            at = np.where(self.automaton.piece[at] >= 0, at, self.automaton.link[at])
            who = np.flatnonzero(at > 0)
            at = at[who]
            while len(who):  # the pieces that end here, longest first
                piece = self.automaton.piece[at]
                size = self.length[piece]
                score = best[t + 1 - size, who + low] + self.score[piece]
                better = score > here[who]
                here[who[better]], by[who[better]] = score[better], piece[better]
                alone[who[size == 1]] = True
                at = self.automaton.link[at]
                some = at > 0
                who, at = who[some], at[some]
            lone = best[t, low:] + self.unknown
            use = ~alone & (lone > here)
            here[use], by[use] = lone[use], -1
            best[t + 1, low:], came[t + 1, low:] = here, by
        # walk back
        place, who = sizes.copy(), np.flatnonzero(sizes > 0)
        back: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))]
        while len(who):
            piece = came[place[who], who]
            place[who] -= np.where(piece >= 0, self.length[piece], 1)
            back.append((who, piece, place[who]))
            who = who[place[who] > 0]
        who, piece, start = (np.concatenate(x) for x in zip(*back, strict=True))
        order = np.lexsort((start, who))
        who, piece, start = who[order], piece[order], start[order]
        ids, times = self._spelled(piece, points[first[who] + start])
        return ids, np.bincount(np.repeat(who, times), minlength=n), best[sizes, np.arange(n)]

    def _in_turn(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_together``, one segment after the other: what a few long segments need."""
        auto = self.automaton
        if not hasattr(self, "_moves"):  # the automaton and scores as plain objects, once a worker
            self._moves = dict(zip(auto.keys.tolist(), auto.to.tolist(), strict=True))
            self._plain = [x.tolist() for x in (auto.fail, auto.link, auto.piece, self.score, self.length)]
        moves, width, (fail, link, pieces, scores, lengths) = self._moves, auto.width, self._plain
        every, counts, totals = [np.empty(0, np.uint32)], [], []
        for segment in segments:
            points = np.frombuffer(segment.encode("utf-32-le"), np.uint32)
            best, came, state = array("d", [0.0]), array("i"), 0
            for t, c in enumerate(auto.code[points].tolist()):
                while (step := moves.get(state * width + c)) is None and state:
                    state = fail[state]
                state = step or 0
                here, by, alone = -np.inf, -1, False
                at = state if pieces[state] >= 0 else link[state]
                while at > 0:  # the pieces that end here, longest first
                    p = pieces[at]
                    size = lengths[p]
                    value = best[t + 1 - size] + scores[p]
                    if value > here:
                        here, by = value, p
                    alone = alone or size == 1
                    at = link[at]
                lone = best[t] + self.unknown
                if not alone and lone > here:
                    here, by = lone, -1
                best.append(here), came.append(by)
            path, place, t = array("i"), array("q"), len(points)
            while t:
                p = came[t - 1]
                t -= lengths[p] if p >= 0 else 1
                path.append(p), place.append(t)
            ids, _ = self._spelled(np.array(path[::-1], np.int64), points[np.array(place[::-1], np.int64)])
            every.append(ids), counts.append(len(ids)), totals.append(best[-1])
        return np.concatenate(every), np.array(counts, np.int64), np.array(totals)

    def _spelled(self, piece: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each gives): unknown characters (-1) as the byte pieces of their UTF-8 form."""
        unknown = piece < 0
        if not self.bytes:
            return np.where(unknown, self.unknown_id, piece).astype(np.uint32), np.ones(len(piece), np.int64)
        extra = (point > 0x7F).astype(np.int64) + (point > 0x7FF) + (point > 0xFFFF)
        times = np.where(unknown, 1 + extra, 1)
        source = np.repeat(np.arange(len(piece)), times)
        rank = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times)
        ids = piece[source].astype(np.int64)
        new = np.flatnonzero(unknown[source])
        c, e, r = point[source[new]].astype(np.int64), extra[source[new]], rank[new]
        lead = np.array([0, 0xC0, 0xE0, 0xF0])[e]
        byte = np.where(r == 0, lead | (c >> (6 * e)), 0x80 | ((c >> (6 * (e - r))) & 0x3F))
        ids[new] = self.byte_ids[byte]
        return ids.astype(np.uint32), times

    def _learn(self, segments: list[str]) -> None:
        ids, at, size, totals = self.viterbi(segments)
        self.at, self.size, self.total = (np.concatenate(x) for x in ((self.at, at + len(self.ids)), (self.size, size), (self.total, totals)))
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, first, scores): text t has ids[first[t]:first[t+1]]."""
        framed = [b" " + t if t else t for t in texts]
        joined = b"".join(framed)
        begin = np.concatenate([[0], np.cumsum([len(t) for t in framed])]).astype(np.int64)
        if not joined:
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts))
        buf = np.frombuffer(joined, np.uint8)
        new = np.zeros(len(buf) + 1, bool)
        if self.splits:
            blank, lone = buf == 32, self.lone[buf]
            new[1:-1] = (blank[1:] & ~blank[:-1]) | lone[1:] | lone[:-1]
        new[begin[:-1][np.diff(begin) > 0]] = True
        starts = np.flatnonzero(new[:-1])
        ends = np.append(starts[1:], len(buf))
        before = self.segments.cleared
        number, missing = self.segments.number(buf, starts, ends)
        if self.segments.cleared != before:
            self._clear()
        if len(missing):
            self._learn([joined[starts[i] : ends[i]].decode().replace(" ", BLANK) for i in missing.tolist()])
        size = self.size[number]
        until = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[number] - until[:-1], size) + np.arange(until[-1])]
        owner = np.searchsorted(starts, begin)  # each text's first segment
        scores = np.concatenate([[0.0], np.cumsum(self.total[number])])
        return ids, until[owner], scores[owner[1:]] - scores[owner[:-1]]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec.load(path)
    return _codecs[path]


def _encoded(path: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts, i, held = as_bytes(batch.column(text_col)), 0, 0
            for j, t in enumerate(texts):
                held += len(t)
                if held >= SEGMENT_BYTES or j + 1 == len(texts):
                    ids, first, scores = own.encode(texts[i : j + 1])
                    blobs = [ids[a:b].astype("<u4").tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                    part = batch.slice(i, j + 1 - i)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(blobs, pa.binary()), pa.array(scores)], names=[*part.schema.names, "ids", "ids_score"])
                    i, held = j + 1, 0
    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.frombuffer(b, "<u4")) for b in as_bytes(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])
    return run


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ids (binary, little-endian unsigned 32-bit) and ids_score; columns of those names are replaced."""
    docs = docs.drop("ids", "ids_score")
    return docs.mapInArrow(_encoded(model, text_col), T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("ids_score", T.DoubleType())]))


def decode(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` with the decoded text of their ids; a column of that name is replaced."""
    rows = rows.drop("decoded")
    return rows.mapInArrow(_decoded(model), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def _there_and_back(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in _encoded(path, "text")(batches):
            same = [own.decode(np.frombuffer(b, "<u4")) == t.decode().replace(BLANK, " ")
                    for b, t in zip(as_bytes(batch.column("ids")), as_bytes(batch.column("text")), strict=True)]
            raw = as_bytes(batch.column("ids"))
            ends = np.cumsum([0, *(len(b) // 4 for b in raw)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([zlib.crc32(b) for b in raw], pa.int64()), batch.column("ids_score"), pa.array(same, pa.bool_())],
                                             names=["doc_id", "ids", "ids_crc32", "score", "round_trip"])
    return run


def digest(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, score, round_trip, ids) of every document: encoded, and decoded again in the same task."""
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = light.mapInArrow(_there_and_back(model), "doc_id long, ids array<int>, ids_crc32 long, score double, round_trip boolean")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", "score", "round_trip", "ids")
