"""SentencePiece encoding and decoding as shortest paths of weighted transducers."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

SPACE = "▁"
SCHEMA = "doc_id long, n_pieces long, n_fallback long, ids_crc32 long, decoded_sha256 string, exact boolean"
#: Piece and model types; fixed by the model files' format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass(frozen=True)
class TransducerConfig:
    """``model`` is a SentencePiece file; the public 32k byte-fallback one by default.

    ``block_chars`` bounds the texts whose segments a task holds at once, ``long_segment`` the
    length up to which segments are composed side by side.
    """

    model: str | None = None
    cache_segments: int = 500_000
    cache_pairs: int = 1 << 21
    block_chars: int = 400_000
    long_segment: int = 64


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a serialized message's fields."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        if size is None:
            size = varint()
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass
class ModelFile:
    """What a model file holds: pieces as (text, score, type), the kind, and the normaliser."""

    pieces: list[tuple[str, float, int]]
    kind: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool

    @classmethod
    def parse(cls, raw: bytes) -> ModelFile:
        pieces, kind, norm = [], UNIGRAM, {}
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(_fields(value))
        return cls(pieces, kind, norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))


def charsmap_rules(blob: bytes) -> dict[str, str]:
    """Rewriting rules of a compiled character map: a double-array trie of sources, then targets."""
    if not blob:
        return {}
    size = struct.unpack("<I", blob[:4])[0]
    units, targets = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    rules, todo = {}, [(offset(units[0]), b"")]
    while todo:
        at, source = todo.pop()
        for c in range(1, 256):
            if (k := at ^ c) < len(units) and units[k] & 0x800000FF == c:
                below, longer = k ^ offset(units[k]), source + bytes([c])
                if units[k] >> 8 & 1:
                    begin = units[below] & 0x7FFFFFFF
                    rules[longer.decode()] = targets[begin : targets.index(b"\0", begin)].decode()
                todo.append((below, longer))
    return rules


class Normaliser:
    """The rewriting transducer of a model's normaliser.

    It reads the longest rule source at each place and writes its target, or copies one
    character; extra spaces go if the model says so; spaces become their visible mark, and one is put
    before a text that isn't empty.
    """

    def __init__(self, model: ModelFile):
        self.rules = charsmap_rules(model.charsmap)
        self.single = str.maketrans({s: t for s, t in self.rules.items() if len(s) == 1})
        longer = sorted((s for s in self.rules if len(s) > 1), key=lambda s: (-len(s), s))
        self.multi = re.compile("|".join(map(re.escape, [*longer, *(s for s in self.rules if len(s) == 1)]))) if longer else None
        self.squeeze, self.mark = model.squeeze, SPACE if model.escape else " "
        self.prefix = self.mark if model.dummy_prefix else ""

    def apply(self, text: str) -> str:
        if self.multi:
            text = self.multi.sub(lambda m: self.rules[m[0]], text)
        elif self.single:
            text = text.translate(self.single)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return self.prefix + text.replace(" ", self.mark) if text else ""

    def invert(self, text: str) -> str:
        return text.replace(SPACE, " ").removeprefix(self.prefix.replace(SPACE, " "))


class PieceTransducer:
    """Normaliser, pieces and byte fallback, composed with an input; paths weigh as in the tropical semiring.

    States of the composition are (position, last piece). An arc reads the characters of a piece,
    or one character outside the vocabulary, which writes its UTF-8 bytes. For a unigram
    model its weight is the piece's negative score, and the last piece doesn't matter. In a byte-pair
    model a boundary between two pieces weighs 1 if merging their characters would undo it, else 0: exactly one
    path of every text has the weight 0, its result of merging, and every beginning of a path of weight 0 is
    one for the text so far. So the shortest-first search meets one state of distance 0
    per position, and never expands another.
    """

    def __init__(self, model: ModelFile, config: TransducerConfig = TransducerConfig()):
        self.config, self.model, self.normaliser = config, model, Normaliser(model)
        kinds = [kind for _, _, kind in model.pieces]
        if BYTE not in kinds or model.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models with byte fallback are compiled")
        if USER_DEFINED in kinds:
            raise ValueError("models with user-defined pieces aren't compiled")
        self.bytes_at = kinds.index(BYTE)
        self.surfaces = [bytes([i - self.bytes_at]) if kind == BYTE else text.encode() if kind == NORMAL else b"" for i, (text, _, kind) in enumerate(model.pieces)]
        self.ids_of = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.scores = {text: model.pieces[i][1] for text, i in self.ids_of.items()}
        self.longest = max(map(len, self.ids_of))
        #: an unknown character weighs more than any piece
        self.unknown = 10.0 - min(self.scores.values())
        #: no piece has a mark after another character, so every path passes such places
        cuttable = not any(SPACE in p.lstrip(SPACE) for p in self.ids_of)
        self.segments = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if cuttable else re.compile(r"(?s).+")
        self.cache: dict[str, bytes] = {}
        self.stable_pairs: dict[tuple[str, str], bool] = {}
        self._compile()

    # definitions

    def merge(self, text: str, down_to: int = 1) -> list[str]:
        """Byte-pair merging as defined: join the adjacent pair of best score, leftmost first."""
        get, none = self.scores.get, -math.inf
        parts = list(text)
        joined = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while len(parts) > down_to and joined and (best := max(joined)) > none:
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(joined):
                joined[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def weight(self, last: str, piece: str) -> float:
        """Weight of the arc that reads ``piece`` in a state whose last piece is ``last`` ("" at the start)."""
        if self.model.kind == UNIGRAM:
            return -self.scores[piece] if piece in self.scores else self.unknown
        if len(self.stable_pairs) > self.config.cache_pairs:
            self.stable_pairs.clear()
        stable = self.stable_pairs.get((last, piece))
        if stable is None:
            stable = self.stable_pairs[last, piece] = self.merge(last + piece) == ([last, piece] if last else [piece])
        return 0.0 if stable else 1.0

    def shortest_path(self, text: str) -> list[str]:
        """Pieces on the path of least weight through the composition with one segment, by position.

        Positions are in topological order. Of the states at one only the nearest is expanded,
        which is all of them for a unigram model and the one at distance 0 for a byte-pair model.
        """
        n, pairs = len(text), self.model.kind == BPE
        distance, last, back = [0.0] + [math.inf] * n, [""] * (n + 1), [0] * (n + 1)
        for begin in range(n):
            if distance[begin] == math.inf:
                continue
            for end in range(begin + 1, min(n, begin + self.longest) + 1):
                piece = text[begin:end]
                if piece in self.ids_of or end == begin + 1:
                    to = distance[begin] + self.weight(last[begin], piece)
                    if to < distance[end] and not (pairs and to):
                        distance[end], last[end], back[end] = to, piece, begin
                elif piece not in self.begins:
                    break
        path = []
        while n:
            path.append(last[n])
            n = back[n]
        return path[::-1]

    def ids(self, path: Iterable[str]) -> list[int]:
        """What the arcs of a path write: a piece's id, or the ids of a character's bytes."""
        out = []
        for piece in path:
            known = self.ids_of.get(piece)
            out += [known] if known is not None else [self.bytes_at + b for b in piece.encode("utf-8", "surrogatepass")]
        return out

    # the same over many segments at once

    def _compile(self) -> None:
        """Pieces as numbers in a trie of numbered characters, with their merges.

        A piece of two or more characters has its ``left`` and ``right`` part, which merging joins last, and
        its ``rank`` among the scores. Pieces that merging never gives are left out. Pieces that share a score
        with another are marked: the order of their merges depends on the place.
        """
        self.begins = {p[:k] for p in self.ids_of for k in range(1, len(p) + 1)}
        self.side_by_side = self.model.kind == BPE
        if not self.side_by_side:
            return
        splits = {p: self.merge(p, 2) for p in self.ids_of}
        names = [p for p, parts in splits.items() if len(parts) <= 2]
        number = {p: k for k, p in enumerate(names)}
        n = self.n = len(names)  # also the number of any unknown character
        ranks = {s: k for k, s in enumerate(sorted({self.scores[p] for p in self.ids_of if len(p) > 1}, reverse=True))}
        shared = np.bincount([ranks[self.scores[p]] for p in self.ids_of if len(p) > 1], minlength=len(ranks)) > 1
        self.rank, self.left, self.right = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.id_of = np.array([self.ids_of[p] for p in names] + [0], np.uint32)
        self.tied = np.zeros(n + 1, bool)
        for p, k in number.items():
            if len(p) > 1:
                self.rank[k], self.tied[k] = ranks[self.scores[p]], shared[ranks[self.scores[p]]]
                self.left[k], self.right[k] = (number[x] for x in splits[p])
        joins = {number[p[:c]] * (n + 1) + number[p[c:]]: ranks[self.scores[p]] for p in self.ids_of for c in range(1, len(p)) if p[:c] in number and p[c:] in number}
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_ranks = np.array([joins[k] for k in self.join_keys.tolist()], np.int64)
        nodes = {"": 0} | {p: k for k, p in enumerate(sorted(self.begins), 1)}
        alphabet = {c: k for k, c in enumerate(sorted({c for p in self.begins for c in p}))}
        self.n_chars = len(alphabet) + 1
        self.char_of = np.full(0x110000, len(alphabet), np.int64)
        self.char_of[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        steps = {nodes[p[:-1]] * self.n_chars + alphabet[p[-1]]: k for p, k in nodes.items() if p}
        self.step_keys = np.array(sorted(steps), np.int64)
        self.step_to = np.array([steps[k] for k in self.step_keys.tolist()], np.int64)
        self.piece_at = np.full(len(nodes), -1, np.int64)
        for p, k in number.items():
            self.piece_at[nodes[p]] = k
        bits = max(1, int(self.config.cache_pairs).bit_length() - 1)
        self.pair_shift = np.uint64(64 - bits)
        self.pair_keys, self.pair_stable = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)

    def _look_up(self, keys: np.ndarray, sorted_keys: np.ndarray, values: np.ndarray, none: int) -> np.ndarray:
        at = np.searchsorted(sorted_keys, keys)
        at[at == len(sorted_keys)] = 0
        return np.where(sorted_keys[at] == keys, values[at], none)

    def _stable(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For pairs of adjacent pieces, whether their boundary weighs 0; a table of fixed size keeps the last ones."""
        keys = x * (self.n + 1) + y
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.pair_shift).astype(np.int64)
        found = self.pair_stable[slots]
        missed = np.flatnonzero(self.pair_keys[slots] != keys)
        if len(missed):
            new, where = np.unique(keys[missed], return_inverse=True)
            fresh = self._survives(new // (self.n + 1), new % (self.n + 1))[where]
            found[missed] = fresh
            self.pair_keys[slots[missed]], self.pair_stable[slots[missed]] = keys[missed], fresh
        return found

    def _survives(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the boundary of two pieces while they are built up.

        Followed backwards: the part that was joined last is taken apart, and what touches the boundary
        then must not have a better merge across it. Equal merges go to the left one first.
        """
        stable, at = np.ones(len(x), bool), np.arange(len(x))
        limit = np.full(len(x), 1 << 60)
        while len(at):
            crossing = self._look_up(x * (self.n + 1) + y, self.join_keys, self.join_ranks, 1 << 61) < limit
            stable[at[crossing]] = False
            go = ~crossing & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            at, x, y = at[go], x[go], y[go]
            a, b = self.rank[x], self.rank[y]
            limit = np.where(a > b, a, b + 1)
            x, y = np.where(a > b, self.right[x], x), np.where(a > b, y, self.left[y])
        return stable

    def compose(self, segments: list[str]) -> list[bytes]:
        """Ids of the shortest paths of many segments, all composed at once and searched position by position."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")
        chars = self.char_of[codes]
        ends = np.cumsum(lengths)
        begins = ends - lengths
        begin_of, end_of = np.repeat(begins, lengths), np.repeat(ends, lengths)
        arcs_from, arcs_piece, arcs_size = [], [], []
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for size in range(1, self.longest + 1):
            node = self._look_up(node * self.n_chars + chars[at + size - 1], self.step_keys, self.step_to, -1)
            piece = np.where(node >= 0, self.piece_at[node], -1)
            if size == 1:
                piece[piece < 0] = self.n
            known = piece >= 0
            arcs_from.append(at[known])
            arcs_piece.append(piece[known])
            arcs_size.append(np.full(int(known.sum()), size))
            on = (node >= 0) & (at + size < end_of[at])
            at, node = at[on], node[on]
            if not len(at):
                break
        start, piece, size = map(np.concatenate, (arcs_from, arcs_piece, arcs_size))
        depth = start - begin_of[start]
        order = np.argsort(depth.astype(np.int16), kind="stable")
        start, piece, size = start[order], piece[order], size[order]
        borders = np.concatenate(([0], np.cumsum(np.bincount(depth))))
        last, back = np.full(len(chars), self.n), np.zeros(len(chars), np.int64)  # by the last character read
        for d in range(len(borders) - 1):
            s, p, z = (a[borders[d] : borders[d + 1]] for a in (start, piece, size))
            if d:
                free = self._stable(last[s - 1], p)
                s, p, z = s[free], p[free], z[free]
            last[s + z - 1], back[s + z - 1] = p, s
        on_path = np.zeros(len(chars), bool)
        now = ends - 1
        while len(now):
            on_path[now] = True
            now = back[now]
            now = now[now > begin_of[now]] - 1
        path, sizes = last[on_path], np.ones(int(on_path.sum()), np.int64)
        unknown = np.flatnonzero(path == self.n)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[on_path][unknown].tolist()]
        sizes[unknown] = list(map(len, raw))
        stops = np.cumsum(sizes)
        ids = np.repeat(self.id_of[path], sizes)
        if raw:  # the bytes of a character take the places of its arc
            ids[np.repeat(path == self.n, sizes)] = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32) + np.uint32(self.bytes_at)
        arcs = np.cumsum(np.add.reduceat(on_path.astype(np.int64), begins))
        written, at = ids.astype("<u4").tobytes(), (4 * stops[arcs - 1]).tolist()
        out = [written[a:b] for a, b in zip([0, *at], at)]
        odd = np.zeros(len(segments), bool)  # tied merges, by themselves
        odd[np.searchsorted(ends, start[self.tied[piece]], side="right")] = True
        for k in np.flatnonzero(odd).tolist():
            out[k] = self._alone(segments[k])
        return out

    def _alone(self, segment: str) -> bytes:
        return np.asarray(self.ids(self.shortest_path(segment)), "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a segment that occurs again is looked up."""
        if len(self.cache) > self.config.cache_segments:
            self.cache.clear()
        cache, texts_of = self.cache, []
        new: set[str] = set()
        for t in texts:
            own = self.segments.findall(self.normaliser.apply(t))
            found = list(map(cache.get, own))
            missing = [i for i, ids in enumerate(found) if ids is None]
            new.update([own[i] for i in missing])
            texts_of.append((found, [(i, own[i]) for i in missing]))
        short = [s for s in new if self.side_by_side and len(s) <= self.config.long_segment]
        size = max(1, self.config.block_chars // 16)
        for a in range(0, len(short), size):
            cache.update(zip(short[a : a + size], self.compose(short[a : a + size])))
        for s in new:
            if s not in cache:
                cache[s] = self._alone(s)
        for found, missing in texts_of:
            for i, segment in missing:
                found[i] = cache[segment]
        return [b"".join(found) for found, _ in texts_of]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all([text])[0], "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The inverse transducers: ids to bytes, bytes to text, marks to spaces."""
        raw = b"".join(map(self.surfaces.__getitem__, ids.tolist()))
        return self.normaliser.invert(raw.decode("utf-8", "replace"))


_COMPILED: dict[TransducerConfig, PieceTransducer] = {}


def compile_model(config: TransducerConfig = TransducerConfig()) -> PieceTransducer:
    """The transducer of a model file, compiled once per process."""
    if config not in _COMPILED:
        import public_tokenizers

        with open(config.model or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
            _COMPILED[config] = PieceTransducer(ModelFile.parse(f.read()), config)
    return _COMPILED[config]


def sentencepiece_codec(docs: DataFrame, config: TransducerConfig = TransducerConfig()) -> DataFrame:
    """Encode and decode each row of ``docs(doc_id, text, ...)``; see ``SCHEMA``.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit numbers, ``exact`` tells
    whether decoding gave the text back (only texts with the space mark itself don't). Null
    text counts as empty, which has no piece. Rows that repeat each return, equal texts with equal
    values; an empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = compile_model(config)
        for batch in batches:
            rows, block, held = [], [], 0

            def close() -> None:
                for text, raw in zip(block, codec.encode_all(block)):
                    ids = np.frombuffer(raw, "<u4")
                    back = codec.decode(ids)
                    fallback = int(((ids >= codec.bytes_at) & (ids < codec.bytes_at + 256)).sum())
                    rows.append((len(ids), fallback, zlib.crc32(raw), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
                block.clear()

            for text in batch["text"]:
                block.append(text.as_py() or "")
                held += len(block[-1])
                if held >= config.block_chars:
                    close()
                    held = 0
            close()
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds))], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op9_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec(table(spark, sf_dir, "documents").select("doc_id", "text"))
