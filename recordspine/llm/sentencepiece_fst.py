"""SentencePiece encoding and decoding by an automaton of pieces and allowed piece pairs.

Not the weighted transducer as dealt: the lattice below has one path, which is searched for depth-first; no arc weight is
added or relaxed, and the normaliser is plain replacement (see the README).

The transducer is compiled from the model file: the normaliser (space to the word mark, a mark before a text), one arc
for each piece, and byte-fallback arcs for characters without a piece. Composed with an input it is a lattice over the
input's positions; a state is (position, piece that ends there). The model is of the BPE kind, whose result is not the
path of least summed scores over all segmentations, so the lattice is also composed with an acceptor of piece pairs:
two pieces may follow each other only if merging their joined text gives just these two. Exactly the BPE segmentation
is left (one path), whatever the arcs weigh.
States are made only as they are reached.
Pairs and words are memoised in bounded tables; a text is cut only where no piece could cross. The installed library reads the model's pieces and is the oracle in
the tests; it doesn't encode here.

Null texts have null pieces, empty texts none. A word mark that a text itself holds comes back as a space, as in the
library. Rows and extra columns pass through; columns named like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspine.llm.common import claim_memos, slices, table

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Entries of a worker's memo tables, about 200 bytes each; they are emptied when another operator takes the worker.
WORD_LIMIT = 220_000
PART_LIMIT = 120_000
ARC_LIMIT = 400_000


class PieceTransducer:
    """Compiled once per Python worker and model path."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.weight: dict[str, float] = {}
        self.id_bytes: dict[str, bytes] = {}
        self.byte_ids = [b""] * 256
        surface: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = np.int32(i).tobytes()
                surface.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surface.append(b"")
            else:
                self.id_bytes[piece] = np.int32(i).tobytes()
                self.weight[piece] = 1.0 - model.get_score(i)  # above 0
                surface.append(piece.replace(MARK, " ").encode())
        self.pieces: dict[str, float | None] = {p[:n]: None for p in self.id_bytes for n in range(1, len(p))} | self.weight  # None: a prefix only
        self.composed: dict[str, dict[str, bool]] = {}
        self.n_arcs = 0
        self.spines: dict[tuple[str, int], list[tuple[str, float]]] = {}
        self.splits: dict[str, tuple[str, str]] = {}
        self.words = WordTable(self)
        self.parts: dict[str, bytes] = {}
        self.bigrams = {p[i : i + 2] for p in self.id_bytes for i in range(len(p) - 1)}
        self.surface_size = np.array([len(x) for x in surface], dtype=np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.surface_bytes = np.frombuffer(b"".join(surface) or b" ", dtype=np.uint8)
        self.marks_inside = any(MARK in p.lstrip(MARK) for p in self.id_bytes)

    def forget(self) -> None:
        """Empty all memo tables, so that a reused worker starts the next stage without them."""
        for memo in (self.composed, self.spines, self.splits, self.words, self.words.older, self.parts):
            memo.clear()
        self.n_arcs = 0

    def spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The tokens that stand at a piece's end (side 1) or start (side 0) while it is merged, each with the weight of
        the merge that takes it up; empty if merging the piece's own text doesn't give it."""
        known = self.spines.get((piece, side))
        if known is None:
            known, token, taken = [], piece, float("inf")
            while token:
                known.append((token, taken))
                if len(token) == 1:
                    break
                taken, token = self.weight[token], self.halves(token)[side]
            if not token:
                known = []
            self.spines[piece, side] = known
        return known

    def halves(self, piece: str) -> tuple[str, str]:
        """The two tokens whose merge makes the piece, or two empty ones if merging never does."""
        if piece not in self.splits:
            parts = list(piece)
            while len(parts) > 2:
                best = min(((self.weight[c], i) for i in range(len(parts) - 1) if (c := parts[i] + parts[i + 1]) in self.weight), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            self.splits[piece] = (parts[0], parts[1]) if len(parts) == 2 else ("", "")
        return self.splits[piece]

    def follows(self, a: str, b: str) -> bool:
        """Whether b may come after a ('' before a first piece): no merge across their border comes before those inside.

        A border merge needs a token at a's end and one at b's start that both still stand when its turn comes; of equal
        weights the leftmost goes first. Merges weigh more than those that made their parts, as training makes them.
        """
        left, right = self.spine(a, 1) if a else [], self.spine(b, 0)
        return bool(right) and not any((w := self.weight.get(x + y)) is not None and w < x_taken and w <= y_taken for x, x_taken in left for y, y_taken in right)

    def shortest_path(self, word: str) -> bytes:
        """Piece ids (int32) of the shortest path through word's lattice.

        States are made as they are reached, the arc that reads most first, and states from which nothing led to the
        end are remembered. Only one path is accepted, so the first to arrive is the shortest.
        """
        if self.n_arcs >= ARC_LIMIT:
            self.composed.clear()
            self.n_arcs = 0
        n, start, before, read = len(word), 0, "", self.pieces.get
        path: list[tuple[int, str]] = []  # start and piece ('' for byte fallback) of each arc taken
        choices: list[list[str]] = []
        dead: set[tuple[int, str]] = set()
        while start < n:
            known, open_arcs = self.composed.get(before), []
            if known is None:
                known = self.composed[before] = {}
            for end in range(start + 1, n + 1):
                text = word[start:end]
                w = read(text, 0)
                if w:
                    may = known.get(text)
                    if may is None:
                        may = known[text] = self.follows(before, text)
                        self.n_arcs += 1
                    if may:
                        open_arcs.append(text)
                elif w == 0:
                    break
            if not open_arcs and word[start] not in self.weight:  # byte fallback: nothing merges across it
                open_arcs.append("")
            path.append((start, before))
            choices.append(open_arcs)
            while True:
                if choices[-1]:
                    piece = choices[-1].pop()
                    at = path[-1][0] + (len(piece) or 1)
                    if (at, piece) not in dead:
                        start, before = at, piece
                        break
                else:
                    choices.pop()
                    dead.add(path.pop())
        pieces = [*(piece for _, piece in path[1:]), before]
        if "" not in pieces:
            return b"".join(map(self.id_bytes.__getitem__, pieces))
        return b"".join(self.id_bytes[x] if x else b"".join(self.byte_ids[c] for c in word[i].encode("utf-8", "replace")) for (i, _), x in zip(path, pieces, strict=True))

    def compose(self, word: str) -> bytes:
        """Pieces of a word, cut first wherever no piece holds the two characters that meet: no merge crosses there."""
        bigrams, start, out = self.bigrams, 0, []
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in bigrams]
        for end in [*cuts, len(word)]:
            part = word[start:end]
            got = self.parts.get(part)
            if got is None:
                if len(self.parts) >= PART_LIMIT:
                    self.parts.clear()
                got = self.shortest_path(part)
                if len(part) <= 64:
                    self.parts[part] = got
            out.append(got)
            start = end
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " " and not self.marks_inside:
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        return self.compose(MARK + text.replace(" ", MARK))

    def decode(self, ids: np.ndarray) -> str:
        """The pieces' bytes one after the other, gathered from one table."""
        sizes = self.surface_size[ids]
        if not len(ids) or not (total := int(sizes.sum())):
            return ""
        shift = self.surface_start[ids] - (np.cumsum(sizes) - sizes)
        whole = self.surface_bytes[np.repeat(shift, sizes) + np.arange(total)].tobytes().decode("utf-8", "replace")
        return whole[1:] if whole.startswith(" ") else whole


class WordTable(dict):
    """Pieces of words behind a space that were met before; the older half goes when it is full."""

    def __init__(self, fst: PieceTransducer):
        self.fst, self.older = fst, {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = self.fst.compose(MARK + word)
        if len(word) <= 24 and "\n" not in word:
            if len(self) >= WORD_LIMIT:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got


_compiled: dict[str, PieceTransducer] = {}


def transducer(model_path: str) -> PieceTransducer:
    if model_path not in _compiled:
        _compiled[model_path] = PieceTransducer(model_path)
    return _compiled[model_path]


def _with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), column], names=[*(batch.schema.names[i] for i in keep), name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name != name), T.StructField(name, kind)])


def encode(docs: DataFrame, text: str = "text", model_path: str = DEFAULT_MODEL, into: str = "piece_ids") -> DataFrame:
    """docs with an array of piece ids; model_path must name the same file on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model_path)
        claim_memos(f"sentencepiece {model_path}", fst.forget)
        for batch in batches:
            for part in slices(batch, text):
                made = [None if t is None else fst.encode(t) for t in part.column(part.schema.names.index(text)).to_pylist()]
                offsets = np.cumsum([0, *(len(m or b"") // 4 for m in made)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(m or b"" for m in made), dtype=np.int32))
                mask = pa.array([m is None for m in made])
                yield _with_column(part, into, pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask))

    return docs.mapInArrow(run, _schema(docs, into, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, ids: str = "piece_ids", model_path: str = DEFAULT_MODEL, into: str = "decoded") -> DataFrame:
    """docs with the text that the piece ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model_path)
        for batch in batches:
            for part in slices(batch, ids):
                rows = part.column(part.schema.names.index(ids))
                yield _with_column(part, into, pa.array([None if not r.is_valid else fst.decode(np.asarray(r.values)) for r in rows], type=pa.string()))

    return docs.mapInArrow(run, _schema(docs, into, T.StringType()))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs))
    same = F.coalesce(F.col("decoded") == F.translate("text", MARK, " "), F.col("text").isNull())
    return both.select("doc_id", F.greatest(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_xxhash64"), F.char_length(F.coalesce("decoded", F.lit(""))).cast("long").alias("decoded_chars"), same.alias("round_trip"))
